"""Operators over the text lines, cells and metrics of approval documents."""
