"""Operators for training-data corpora; nothing outside this folder imports it."""
