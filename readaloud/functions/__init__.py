"""Column functions: HTML, text, URL and status rules over built-in expressions."""
