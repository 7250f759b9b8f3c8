"""DataFrame operators: extraction, speech preparation, chunks, language, feeds, jobs, checks."""
