"""Reviewer answers as a log: batch replay and Structured Streaming."""
