"""Column expressions and scoring kernels."""
