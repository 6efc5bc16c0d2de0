"""Operators for preparing training text: one module each, with their queries and SQL; nothing else in the package needs them."""
