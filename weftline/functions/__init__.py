"""Column functions: positional randomness and value rules."""
