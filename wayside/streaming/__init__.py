"""Structured Streaming forms of the operators (an extension)."""
