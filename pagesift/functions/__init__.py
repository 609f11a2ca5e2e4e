"""Column expressions: text, URLs, times, embedded JSON."""
