"""Operators of a pipeline for language-model training data; nothing else in the library imports them."""
