"""Column expressions for keys, bands, windows and rows as text."""
