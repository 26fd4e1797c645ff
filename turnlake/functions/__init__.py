"""Column expressions: no action, no shuffle of their own."""
