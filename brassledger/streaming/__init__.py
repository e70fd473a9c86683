"""The same jobs over arriving data."""
