"""Column-expression builders (parsing, formatting, fixed label values)."""
