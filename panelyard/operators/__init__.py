"""Relational and statistical operators over long panels."""
