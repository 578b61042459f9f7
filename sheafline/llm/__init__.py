"""Operators for text of training corpora. Nothing outside this folder imports it."""
