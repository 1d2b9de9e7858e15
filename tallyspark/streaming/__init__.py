"""Keyed state over conversations and events."""
