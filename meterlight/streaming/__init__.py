"""Structured Streaming forms of the operators, and runs that keep tables up to date."""
