"""Structured Streaming forms of the sample refresh and the commit log."""
