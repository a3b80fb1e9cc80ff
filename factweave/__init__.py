"""Fact extraction and fusion for web-facing material at rest, on Spark."""
