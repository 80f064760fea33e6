"""Column expressions: text, boxes and points, HTML tables."""
