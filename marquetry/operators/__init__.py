"""operators of marquetry."""
