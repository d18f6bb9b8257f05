"""Operators for preparing training data at scale, each in a module of its own."""
