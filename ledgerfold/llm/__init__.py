"""Operators for large text corpora: tokens, fingerprints, packing, filters and classifiers."""
