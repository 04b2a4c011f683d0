"""Scalar expressions, all evaluated inside the JVM."""
