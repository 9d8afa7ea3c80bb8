"""Operators over elements, chunks and fragments."""
