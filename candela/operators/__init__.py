"""Relational operators over bars, segments, signatures, outcomes and estimates."""
