"""Structured Streaming: capture routing, connection audits, live books and features."""
