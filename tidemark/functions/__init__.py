"""Column-expression helpers and fixed values shared by all operators."""
