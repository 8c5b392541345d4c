"""Operators for training-data pipelines, one module each; queries.py registers them."""
