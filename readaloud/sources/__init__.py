"""Table reads, derived application tables and sinks."""
