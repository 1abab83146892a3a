"""Column functions: text, metrics, answers and options."""
