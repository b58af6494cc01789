"""Operators for large training-data pipelines. Nothing else in marquetry imports this subpackage."""
