"""Readers, load gates and table writers."""
