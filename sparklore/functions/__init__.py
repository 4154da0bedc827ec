"""Column functions and per-text rules."""
