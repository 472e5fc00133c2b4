"""Operators for texts of language models. Nothing outside this folder imports it."""
