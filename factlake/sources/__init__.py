"""Readers and writers of fact tables, imports, exports and logs."""
