"""Readers, writers and declared column mappings."""
