"""The catalogue of queries: name -> function of (spark, sf_dir), and the SQL that must give the same rows."""

from lexloom.plans.documents import ORACLES as _DOCUMENT_SQL
from lexloom.plans.documents import QUERIES as _DOCUMENTS
from lexloom.plans.jobs import ORACLES as _JOB_SQL
from lexloom.plans.jobs import QUERIES as _JOBS
from lexloom.plans.retrieval import ORACLES as _RETRIEVAL_SQL
from lexloom.plans.retrieval import QUERIES as _RETRIEVAL

QUERIES = {**_RETRIEVAL, **_DOCUMENTS, **_JOBS}
ORACLES = {**_RETRIEVAL_SQL, **_DOCUMENT_SQL, **_JOB_SQL}

__all__ = ["ORACLES", "QUERIES"]
