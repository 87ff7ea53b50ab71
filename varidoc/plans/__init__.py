"""Expressions planned from text: key paths and document templates."""
