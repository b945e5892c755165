"""Structured Streaming: the daily reduction of an hourly stream."""
