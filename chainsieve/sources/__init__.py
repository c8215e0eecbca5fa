"""Reading, parsing and writing of the canonical tables."""
