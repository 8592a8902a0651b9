"""Readers and derived carrier tables."""
