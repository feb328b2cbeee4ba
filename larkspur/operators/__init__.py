"""Projection, filter, aggregation and ordering operators."""
