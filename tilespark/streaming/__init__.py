"""Structured Streaming jobs over request logs and tile updates."""
