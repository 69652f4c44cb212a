"""Structured Streaming: staged ingest that resumes, and a stateful throttle."""
