"""Column-expression builders and small driver-side value objects."""
