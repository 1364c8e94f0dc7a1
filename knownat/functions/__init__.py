"""Column expressions: no shuffle, no action."""
