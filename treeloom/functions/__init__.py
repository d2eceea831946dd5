"""Column functions: costs of leaf pairs, text and number parsing."""
