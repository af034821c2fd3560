"""Operators, DataFrames in and out: pages, segments, vectors, fusion, context, registry, events."""
