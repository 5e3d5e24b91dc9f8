"""Structured Streaming extensions; the rankings themselves are batch queries."""
