"""Operators that prepare data for training language models."""
