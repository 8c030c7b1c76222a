"""Causeway: road-network resilience analytics, and training-data operators, on PySpark DataFrames."""
