"""Model providers: completions and embeddings."""
