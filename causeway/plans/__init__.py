"""Shared plan building: durable intermediate tables and fixpoint loops."""
