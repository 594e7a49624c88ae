"""Operators over change logs, tables, metadata and run metrics."""
