"""Structured Streaming forms of the flow and alert operators."""
