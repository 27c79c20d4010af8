"""Whole runs: scan, session, status, and the registered queries."""
