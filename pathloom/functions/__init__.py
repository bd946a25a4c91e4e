"""Column functions, vectors and model hooks."""
