"""Column functions: scalars over text, time, vectors and nested values."""
