"""Operators that prepare text corpora and embeddings for training."""
