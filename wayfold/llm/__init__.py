"""Operators for training-data pipelines, kept apart from the trace engine."""
