"""Readers: archives, JSON collections, sealed manifests, run folders, and a data source for model calls."""
