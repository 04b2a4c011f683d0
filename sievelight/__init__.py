"""Sensitive-data detection and adjudication over span DataFrames."""
