"""Readers, writers, generators, artifact layout and manifests."""
