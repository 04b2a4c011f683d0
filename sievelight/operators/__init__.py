"""Operators over span and detection tables."""
