"""Column functions: text, formats, coercion and dates."""
