"""Column functions: box geometry, flight geometry, names."""
