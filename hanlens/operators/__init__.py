"""Detectors, dictionary matching, span algebra, annotation, scoring and rewriting."""
