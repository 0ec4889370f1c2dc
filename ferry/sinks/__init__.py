"""Sinks of ferry."""
