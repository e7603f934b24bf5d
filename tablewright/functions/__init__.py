"""Column expressions and scalar special functions."""
