"""Structured Streaming surface: live scoring of running cases."""
