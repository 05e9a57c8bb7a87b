"""Structured Streaming forms of the operational conditions and of the intake."""
