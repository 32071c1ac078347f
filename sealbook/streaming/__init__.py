"""Metering over Structured Streaming."""
