"""lintlake.sources."""
