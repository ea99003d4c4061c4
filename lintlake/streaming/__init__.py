"""lintlake.streaming."""
