"""Column expressions: no shuffle, no action, safe inside any select."""
