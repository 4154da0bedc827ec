"""Fixed relational views over the driver tables."""
