"""Operators for large training-data corpora. Nothing else in this library imports this subpackage."""
