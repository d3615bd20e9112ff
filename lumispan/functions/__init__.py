"""Column expressions and derived tables."""
