"""Evidence retrieval: TF-IDF index, ranked and diversified search, summaries."""
