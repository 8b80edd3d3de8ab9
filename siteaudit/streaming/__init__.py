"""Structured Streaming jobs over requests, reports, audits and failures."""
