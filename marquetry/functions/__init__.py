"""functions of marquetry."""
