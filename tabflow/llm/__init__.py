"""Operators that prepare text, pages and vectors for the training of language models."""
