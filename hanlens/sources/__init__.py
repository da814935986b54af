"""Readers of documents and side tables, and the sinks of reports."""
