"""sources of hydroframe."""
