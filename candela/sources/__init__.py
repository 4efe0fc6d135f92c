"""Readers, writers and the builder of bars from events."""
