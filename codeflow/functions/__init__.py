"""Column functions on texts, names and paths."""
