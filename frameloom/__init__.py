"""Frameloom: sparse position detections to complete, audited presence timelines, on Spark."""
