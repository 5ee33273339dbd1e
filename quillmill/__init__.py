"""Quillmill: DataFrame operators over translation corpora, on Apache Spark."""

__version__ = "0.1.0"
