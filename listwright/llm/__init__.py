"""Operators for preparing training data: filters, models, similarity joins, mixing and packing."""
