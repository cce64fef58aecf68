"""Column expressions shared by the operators (Column in, Column out)."""
