"""Column functions for request keys, paths and sizes."""
