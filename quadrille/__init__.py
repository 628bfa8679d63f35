"""Quadrille: rule discovery, audit and document preparation for gridded data, on Spark DataFrames."""

__version__ = "0.1.0"
