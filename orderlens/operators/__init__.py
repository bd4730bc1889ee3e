"""Relational building blocks that Spark has no single operator for."""
