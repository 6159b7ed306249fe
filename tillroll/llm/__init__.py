"""Operators for training-data tables: documents, pages of a benchmark, labels, conversations."""
