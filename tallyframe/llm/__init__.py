"""Operators of a training-data pipeline for language models; nothing else in the library imports them."""
