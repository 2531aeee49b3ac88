"""Column expressions and fixed value lists."""
