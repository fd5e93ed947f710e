"""Operators of the file-inspection engine."""
