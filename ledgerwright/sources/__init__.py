"""Readers, writers and reference data."""
