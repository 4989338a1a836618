"""Column functions: bands, text coercion, exact averages, sentence formatting."""
