"""Plans of ferry."""
