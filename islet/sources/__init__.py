"""Readers and writers: packed edge files, text edge lists, result files."""
