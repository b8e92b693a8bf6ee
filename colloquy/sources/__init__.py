"""Readers of chat exports, and sinks."""
