"""Readers, vendor layouts and writers for bar tables."""
