"""Structured Streaming forms of the asynchronous operators."""
