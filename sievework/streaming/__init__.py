"""Streaming of the file-inspection engine."""
