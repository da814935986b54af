"""Column functions: characters, spans, scalars."""
