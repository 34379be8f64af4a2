"""Operators for training-data corpora: text, pages, archives and vectors at cluster scale."""
