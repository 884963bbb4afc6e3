"""Structured Streaming operators: the keyed state machine and event-time windows."""
