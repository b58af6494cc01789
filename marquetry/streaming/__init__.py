"""streaming of marquetry."""
