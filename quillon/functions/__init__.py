"""Column expressions: text, time, hashes, statistics."""
