"""Operators for training-data pipelines (deduplication, filtering, mixing,
tokenisation), each a Spark job over a documents-like DataFrame.  Nothing else
in the library imports this subpackage."""
