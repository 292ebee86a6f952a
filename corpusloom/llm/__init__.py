"""Operators for training corpora: extraction, deduplication, filtering, formatting, packing and storage."""
