"""Column functions without a shuffle."""
