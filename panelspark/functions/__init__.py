"""Column functions and small table transformations."""
