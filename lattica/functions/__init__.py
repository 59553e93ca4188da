"""Column expressions and small driver-side parameter functions."""
