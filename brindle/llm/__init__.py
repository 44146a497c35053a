"""Operators for language-model training text. Nothing outside imports this subpackage."""
