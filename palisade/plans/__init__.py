"""Whole pipelines put together from the operators."""
