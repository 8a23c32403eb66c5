"""Column functions and row filters."""
