"""Declarative query plans and what they compile to."""
