"""Stowage: object-inventory reconciliation and transfer analytics as Spark DataFrames."""
