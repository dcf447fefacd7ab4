"""Column functions and storage of intermediate results."""
