"""Operators for large text corpora: tokens, languages, duplicates, leaks, licences, web archives."""
