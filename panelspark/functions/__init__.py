"""Column functions: keys, text and dates."""
