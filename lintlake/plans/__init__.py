"""lintlake.plans."""
