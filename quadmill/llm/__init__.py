"""Operators for building training corpora. Nothing else in quadmill imports this."""
