"""Codebase analytics and search as declarative PySpark plans."""
