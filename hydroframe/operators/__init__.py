"""operators of hydroframe."""
