"""Column functions on exchange matrices."""
