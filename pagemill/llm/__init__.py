"""Operators for the preparation of language-model training text. Nothing else in the library imports this subpackage."""
