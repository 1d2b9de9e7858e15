"""Column functions and the catalogue."""
