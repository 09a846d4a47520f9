"""Column functions: text, money and time."""
