"""Structured Streaming forms of the lifecycle and of the reports."""
