"""Column expressions, special functions and small solvers."""
