"""Source trees, parsers and the registry of repositories."""
