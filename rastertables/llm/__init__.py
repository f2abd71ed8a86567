"""Operators for training-data pipelines on text tables. Nothing else in the library imports this subpackage."""
