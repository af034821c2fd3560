"""Streams of job events and registry operations over the same folds as the batch operators."""
