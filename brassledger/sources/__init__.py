"""Raw files and adapters turned into typed tables."""
