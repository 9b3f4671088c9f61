"""Readers, writers and generators of samples, trails and rules."""
