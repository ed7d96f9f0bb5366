"""Readers and writers of the file formats, and the paged SQL surface."""
