"""Operators for large text corpora: tokens, mixtures, packing, near copies, privacy, pages, vectors, quality."""
