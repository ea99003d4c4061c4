"""lintlake.sinks."""
