"""Operators for training data: defects, samples, copies, splits, near-duplicates, token ids, leaks and personal data."""
