"""Queries over the driver tables, one module for each layer, each with its SQL twin."""
