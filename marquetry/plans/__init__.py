"""plans of marquetry."""
