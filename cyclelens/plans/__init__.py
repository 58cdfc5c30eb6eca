"""Metric plans: one module per subject, every plan a function returning a DataFrame."""
