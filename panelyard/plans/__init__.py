"""Staged decisions over many candidates."""
