"""Structured Streaming.

The engine's operators work on bounded edge tables: every result (labels, forest, census) is a
function of the whole graph. No streaming operator is offered.
"""
