"""Operators on rows: vectors, scores, snapshots, windows and terms."""
