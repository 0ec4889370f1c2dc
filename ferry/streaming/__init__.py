"""Streaming of ferry."""
