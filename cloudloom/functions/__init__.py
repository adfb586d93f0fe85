"""Column expressions: packing, rounding, geometry, text."""
