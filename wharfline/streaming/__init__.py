"""Structured streams, with batch forms where the same question is asked of a table."""
