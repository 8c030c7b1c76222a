"""Readers and writers of networks."""
