"""Operators for large text-corpus preparation. Nothing outside this folder imports it."""
