"""Column expressions shared by the metric plans."""
