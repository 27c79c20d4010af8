"""Relational operators over lines, messages and findings."""
