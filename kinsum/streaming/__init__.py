"""Change-feed maintenance of the wide table (Structured Streaming)."""
