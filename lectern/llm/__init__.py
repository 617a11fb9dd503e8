"""Operators for training text: sentences, page noise, names, matching, tokens, leaks, residue."""
