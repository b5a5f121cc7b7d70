"""Micro-batch operators: cycles, alerts, and the property state machine, on Structured Streaming."""
