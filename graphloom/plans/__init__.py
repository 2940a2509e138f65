"""Whole results put together from the operators: diagrams, views, diagnostics and reports."""
