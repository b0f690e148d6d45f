"""Strandlog: versioned, append-only datasets and the data preparation around them, on Spark."""

__version__ = "0.1.0"
