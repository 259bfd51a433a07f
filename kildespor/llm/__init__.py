"""Operators for preparing training data at the scale of a text corpus."""
