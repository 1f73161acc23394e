"""Column functions: text, token sets and vectors."""
