"""Operators for building training data: one module per operator."""
