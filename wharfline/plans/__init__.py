"""Jobs: import, export and their sinks."""
