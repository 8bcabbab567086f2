"""SQL registration of the scalar functions (UDF1, UDF2).

The functions are registered as Spark SQL functions whose body is a SQL
expression (``CREATE TEMPORARY FUNCTION ... RETURN``).  Spark inlines such
bodies into the calling plan, so they stay inside whole-stage codegen,
unlike a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# name -> (parameters, return type, body); NULL reads as 0, as in SQLite.
SQL_FUNCTIONS = {
    "xor": ("a BIGINT, b BIGINT", "BIGINT", "coalesce(a, 0L) ^ coalesce(b, 0L)"),
    "hamming1": ("a BIGINT, b BIGINT", "INT", "bit_count(coalesce(a, 0L) ^ coalesce(b, 0L))"),
    "hamming2": ("a BIGINT, b BIGINT", "INT", "bit_count(coalesce(a, 0L) ^ coalesce(b, 0L))"),
    "hamming3": ("a BIGINT, b BIGINT", "INT", "bit_count(coalesce(a, 0L) ^ coalesce(b, 0L))"),
    # 32-bit read, sign-extended to 64 bits before counting.
    "popcount": ("x BIGINT", "INT",
                 "bit_count(((coalesce(x, 0L) & 4294967295L) ^ 2147483648L) - 2147483648L)"),
}


def register_function(spark: SparkSession, name: str, params: str, returns: str, body: str) -> None:
    """UDF2: register a SQL-bodied function under ``name`` for this session."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")


def register_sql(spark: SparkSession) -> None:
    """UDF1: make ``xor, hamming1..3, popcount`` callable from SQL text."""
    for name, (params, returns, body) in SQL_FUNCTIONS.items():
        register_function(spark, name, params, returns, body)
