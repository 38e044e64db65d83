"""Column expressions: types, text, codes."""
