"""Readers for landed files and writers for finished tables."""
