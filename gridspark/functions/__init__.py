"""Column-level functions: pure expressions, no UDFs."""
