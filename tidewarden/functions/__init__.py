"""Column functions and the fixed tables they are built from."""
