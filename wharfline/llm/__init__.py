"""Operators for preparing language-model training data, each usable alone on a documents DataFrame."""
