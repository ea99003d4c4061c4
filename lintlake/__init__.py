"""lintlake."""
