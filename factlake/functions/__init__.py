"""Column functions: pure expressions over columns, no DataFrame needed."""
