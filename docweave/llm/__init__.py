"""Operators for preparing training data for language models. Nothing outside this folder imports it."""
