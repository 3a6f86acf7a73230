"""Scanner, text rules and column expressions."""
