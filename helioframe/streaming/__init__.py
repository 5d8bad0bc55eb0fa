"""Structured Streaming versions of the nowcast operators."""
