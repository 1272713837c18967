"""Column functions over text, vectors and metadata."""
