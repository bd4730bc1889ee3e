"""Order-operations analytics on Spark: star schema, risk scores, evidence retrieval."""

__version__ = "0.1.0"
