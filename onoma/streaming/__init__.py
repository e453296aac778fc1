"""Structured Streaming use of the same operators."""
