"""Operators on text and training data; nothing else in the library needs this subpackage."""
