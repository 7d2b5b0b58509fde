"""Column expressions and batched kernels shared by the operators."""
