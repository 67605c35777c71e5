"""Readers (A1-A9) and writers."""
