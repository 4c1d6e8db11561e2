"""Column functions: alphabets, identifiers, geometry, random keys."""
