"""Sources: commits and changed files as landed tables, rule files, vectors from a cache or a model."""
