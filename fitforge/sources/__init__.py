"""Readers that bring payloads into one shape."""
