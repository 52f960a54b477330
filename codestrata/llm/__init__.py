"""Operators that prepare source code and text for training language models."""
