"""Readers, writers and data gates."""
