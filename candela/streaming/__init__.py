"""Stateful matching of signatures over live bars."""
