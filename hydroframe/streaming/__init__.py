"""streaming of hydroframe."""
