"""Lectern: context-based citation analytics as Spark plans."""
