"""Operators that prepare text for training: quality, languages, duplicates, leaks, mixing."""
