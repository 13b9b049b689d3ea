"""Profiling, normalizing and anonymizing tables with Spark expressions."""
