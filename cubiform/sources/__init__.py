"""Reading, encoding and writing discrete tables."""
