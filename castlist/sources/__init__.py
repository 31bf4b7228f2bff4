"""Readers and writers of text files."""
