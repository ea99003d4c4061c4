"""lintlake.operators."""
