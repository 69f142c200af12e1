"""revlens package."""
