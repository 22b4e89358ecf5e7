"""Keeping the graph current as files change."""
