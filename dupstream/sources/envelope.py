"""Post pages as delivered by the site's API (SRC3, SRC4).

A page is a response envelope ``{"success": ..., "status": ..., "data": ...}``
whose ``data`` is a list of post objects on success and an error object
otherwise.  Envelopes are read as text (one JSON document per line) and
split into ok / error / corrupt pages; the post objects of ok pages are
parsed with an explicit schema, and non-object elements are counted as
errors as the reference counts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dupstream.schemas import ENVELOPE, POST_JSON

# messages of failed requests without an error text of their own
EMPTY_RESPONSE = "empty response"
EMPTY_RETURN = "empty return"


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Captured response bodies, one per line: ``page`` (file line order is
    not meaningful, so the page number is read from the file name) and
    ``body``."""
    return (spark.read.text(path)
            .select(F.regexp_extract(F.input_file_name(), r"(\d+)[^/]*$", 1).cast("bigint").alias("page"),
                    F.col("value").alias("body")))


def read_posts_json(spark: SparkSession, path: str) -> DataFrame:
    """Bare post objects (JSON lines) with the explicit post schema; bad
    lines land in ``_corrupt_record``."""
    # a schema of its own: StructType.add would change the shared one
    schema = T.StructType([*POST_JSON.fields, T.StructField("_corrupt_record", T.StringType(), True)])
    return (spark.read.schema(schema).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def split_envelopes(envelopes: DataFrame) -> DataFrame:
    """SRC4: per page ``page, outcome ('ok'|'error'|'corrupt'), elements
    (raw JSON of each data element, ok pages only), error_message``."""
    e = F.from_json(F.col("body"), ENVELOPE)
    # from_json keeps what it could read of a truncated body; a body only
    # counts when it is valid JSON as a whole.  An empty body is a failed
    # request (not a corrupt page), as is any envelope whose success flag is
    # not true.
    parsed = envelopes.select("page", e.alias("e"), F.try_parse_json(F.col("body")).isNull().alias("bad"),
                              (F.trim(F.coalesce(F.col("body"), F.lit(""))) == "").alias("empty"))
    outcome = (F.when(F.col("empty"), "error")
               .when(F.col("bad") | F.col("e.success").isNull(), "corrupt")
               .when(F.col("e.success"), "ok").otherwise("error"))
    elements = F.from_json(F.col("e.data"), T.ArrayType(T.StringType()))
    message = (F.when(F.col("empty"), F.lit(EMPTY_RESPONSE))
               .otherwise(F.coalesce(F.get_json_object(F.col("e.data"), "$.error.message"), F.lit(EMPTY_RETURN))))
    return parsed.select(
        "page", outcome.alias("outcome"),
        F.when(outcome == "ok", elements).alias("elements"),
        F.when(outcome == "error", message).alias("error_message"))


def page_posts(split: DataFrame) -> DataFrame:
    """SRC3: the post objects of ok pages, parsed; non-object elements are
    kept with ``is_object = false`` so they can be counted as errors."""
    el = split.filter(F.col("outcome") == "ok").select("page", F.explode("elements").alias("raw"))
    is_obj = F.trim(F.col("raw")).startswith("{")
    return el.select("page", is_obj.alias("is_object"),
                     F.when(is_obj, F.from_json(F.col("raw"), POST_JSON)).alias("post"))


def page_summary(split: DataFrame) -> DataFrame:
    """Per page: outcome, post objects, non-object elements, error text."""
    counts = (page_posts(split).groupBy("page")
              .agg(F.count_if(F.col("is_object")).alias("n_posts"),
                   F.count_if(~F.col("is_object")).alias("n_bad")))
    return (split.select("page", "outcome", "error_message").join(counts, "page", "left")
            .select("page", "outcome", F.coalesce("n_posts", F.lit(0)).alias("n_posts"),
                    F.coalesce("n_bad", F.lit(0)).alias("n_bad"), "error_message"))
