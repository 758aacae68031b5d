"""Column functions and the tables they follow."""
