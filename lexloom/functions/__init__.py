"""Column functions: text normalisation, identifiers, headings, answers, events."""

from lexloom.functions.answers import *  # noqa: F403
from lexloom.functions.identifiers import *  # noqa: F403
from lexloom.functions.text import *  # noqa: F403
