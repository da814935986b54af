"""Whole-corpus plans: the scan, and the reports over its issues."""
