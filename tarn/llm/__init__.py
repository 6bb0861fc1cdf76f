"""Operators for building training corpora: media, quality, archives, dedup, packing."""
