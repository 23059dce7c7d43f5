"""Column builders: boxes, identifiers, coordinates and predicates."""
