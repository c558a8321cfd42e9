"""Readers: each gives good rows and bad rows on one plan, with file and line."""
