"""Matching of streams."""
