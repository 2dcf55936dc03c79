"""Corpus-scale PHI/PII de-identification and evaluation on Spark DataFrames."""

__version__ = "0.1.0"
