"""Column expressions: box geometry, polygons and text."""
