"""sources of marquetry."""
