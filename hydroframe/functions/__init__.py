"""functions of hydroframe."""
