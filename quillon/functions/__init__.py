"""Column expressions: symbols, hashes and field arithmetic."""
