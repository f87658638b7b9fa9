"""Operators for preparing training data: tokenising, packing, splitting, selection, search."""
