"""Readers, registries and derived views."""
