"""Operators of a training-data pipeline over text corpora, each with its own module."""
