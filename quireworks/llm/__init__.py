"""Operators for training-data pipelines, one module each.  Nothing outside this subpackage imports it."""
