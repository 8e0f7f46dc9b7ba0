"""Structured Streaming jobs over the task log; each has a batch twin among the registered queries."""
