"""Column builders: keyed draws and scalar helpers."""
