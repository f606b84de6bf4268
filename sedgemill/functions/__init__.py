"""Subpackage of sedgemill."""
