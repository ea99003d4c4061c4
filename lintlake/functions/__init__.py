"""lintlake.functions."""
