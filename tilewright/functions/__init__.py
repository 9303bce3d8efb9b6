"""Column expressions: shapes, polygons, pixels."""
