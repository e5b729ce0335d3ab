"""Operators that build training corpora; nothing outside this subpackage imports it."""
