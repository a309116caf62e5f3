"""Argument mining and counterargument retrieval as lazy PySpark DataFrame operations."""
