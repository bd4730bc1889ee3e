"""Table builders and reports: DataFrame in, DataFrame out."""
