"""Operators for preparing training data for language models. Nothing outside imports this."""
