"""Recall, precision, latency, balance and cost of searches and indexes."""
