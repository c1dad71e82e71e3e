"""Whole queries over the event tables, and reports."""
