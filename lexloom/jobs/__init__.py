"""Whole jobs over the operators: ingesting documents, answering questions."""
