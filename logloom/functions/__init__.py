"""Column functions: levels, times, text."""
