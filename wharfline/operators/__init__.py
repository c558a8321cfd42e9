"""Operators over DataFrames. ``as_of`` is always given; nothing reads the clock."""
