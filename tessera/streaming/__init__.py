"""Structured Streaming operators over arriving trials, responses and files."""
