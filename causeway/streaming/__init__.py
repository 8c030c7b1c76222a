"""Estimates that grow batch by batch."""
