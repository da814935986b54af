"""The scan over files as they arrive."""
