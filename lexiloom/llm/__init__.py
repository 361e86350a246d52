"""Operators that prepare training data: private data, duplicates, languages, markup, packing and token files."""
