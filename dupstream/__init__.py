"""dupstream: exact and near-duplicate image analytics on Spark.

Layout: ``functions`` (Column expressions and SQL-registered functions),
``sources`` (parquet inputs, derived tables, image files, API pages),
``operators`` (pair index, history, lookups, reports, limits, ingest, store,
statistics), ``streaming`` (incremental index, stateful limiter) and
``plans`` (registered queries and their SQL oracles).  Every operator takes
and returns DataFrames; call ``dupstream.session.prepare(spark)`` once on a
session built elsewhere.
"""

__version__ = "0.1.0"
