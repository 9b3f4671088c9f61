"""Incremental learning over streams of samples."""
