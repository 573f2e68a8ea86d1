"""Column functions; all are built-in expressions, none is a Python UDF."""
