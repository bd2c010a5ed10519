"""Ordered-sequence analytics on PySpark: timed tokens, boundaries, edit lists, queues, streams."""
