"""Columns over ordered series."""
