"""Structured Streaming: ingestion, live quotas, windowed counts and progress."""
