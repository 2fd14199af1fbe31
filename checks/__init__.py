"""Driver queries over the generic test tables and their SQL counterparts."""
