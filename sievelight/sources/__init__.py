"""Readers and writers of line files and state."""
