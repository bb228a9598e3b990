"""Column functions: text, hashing and arithmetic."""
