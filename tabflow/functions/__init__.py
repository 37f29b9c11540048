"""Column expressions, aggregate functions and skew handling shared by the operators."""
