"""Whole queries composed of operators, and the views that feed them."""
