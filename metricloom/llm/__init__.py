"""Operators of a training-data pipeline: language, near copies, repeats, leaks, filters and mixing."""
