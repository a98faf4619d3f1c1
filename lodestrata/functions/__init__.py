"""lodestrata package part."""
