"""Alignment of arrays, and what is computed over reports."""
