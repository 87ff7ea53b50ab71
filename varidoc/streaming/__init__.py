"""Streams of documents."""
