"""Column expressions and small driver-side sequences."""
