"""URL filter: rules first, then logistic regression on hashed character n-grams.

Only DataFrame functions and Spark's own ML estimators run here.  The regression
is fitted on a small labelled URL table: at most ``TRAIN_ROWS`` URLs of each label,
picked by hash; every URL is then scored in place, with no shuffle.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.
Path: then up to ``?``, ``#`` or the end.  Null URLs and URLs without ``://`` have
both empty.  A rule ``(host, path)`` fits its host and all subdomains when the URL's
path starts with its path; the longest fitting rule wins, of equally long ones the
first in alphabetical order.

Defined results: every row is returned, repeated ones too; ids may be null; with no
labelled rows, or rows of one label only, that label (or ``allow``) is the method's
verdict; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 14
TRAIN_ROWS = 2_000
GRAM_SIZES = (3, 4)
SCORED = "features"

# Host names of the unwanted sites that the small labelled table knows.
UNWANTED_HOSTS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def split_url(url) -> tuple:
    """(host, path) of a URL column."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(whole, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(whole, pattern, 2)


def rule_of(host, path, rules: list[tuple[str, str, str]]) -> tuple:
    """(rule, verdict) of the longest fitting rule, null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def _grams(text, mark: str):
    """Character n-grams of a column with its ends marked."""
    whole = F.concat(F.lit("^"), text, F.lit("$"))
    arrays = [F.when(F.length(whole) >= n, F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(whole) - n + 1, F.lit(1))),
        lambda i, n=n: F.concat(F.lit(mark), F.substring(whole, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))
        for n in GRAM_SIZES]
    return F.concat(*arrays)


def with_grams(urls: DataFrame, url_col: str = "url") -> DataFrame:
    host, path = split_url(F.col(url_col))
    return (urls.withColumn("host", host).withColumn("path", path)
            .withColumn("grams", F.array_distinct(F.concat(_grams(F.col("host"), "h"), _grams(F.col("path"), "p")))))


def labelled_urls(pages: DataFrame, per_label: int = TRAIN_ROWS) -> DataFrame:
    """The small labelled table: ``url``, ``label`` (1.0 is unwanted), at most
    ``per_label`` distinct URLs of each label in hash order."""
    host, _ = split_url(F.col("url"))
    unwanted = F.exists(F.split(host, r"\."), lambda part: part.isin(*UNWANTED_HOSTS))
    known = (pages.select("url").filter(F.col("url").isNotNull())
             .withColumn("label", F.when(unwanted, 1.0).otherwise(0.0)))
    picked = [known.filter(F.col("label") == v).distinct().orderBy(F.xxhash64("url"), "url").limit(per_label)
              for v in (0.0, 1.0)]
    return picked[0].unionAll(picked[1])


def fit(labelled: DataFrame, features: int = FEATURES, iterations: int = 60):
    """Fitted model, or the one label (0.0 or 1.0) that the table holds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return next(iter(counts), 0.0)
    total = sum(counts.values())
    weight = F.when(F.col("label") == 1.0, total / (2 * counts[1.0])).otherwise(total / (2 * counts[0.0]))
    rows = HashingTF(numFeatures=features, binary=True, inputCol="grams", outputCol=SCORED).transform(
        with_grams(labelled)).withColumn("weight", weight).select(SCORED, "label", "weight")
    return LogisticRegression(featuresCol=SCORED, labelCol="label", weightCol="weight", maxIter=iterations,
                              regParam=1e-3, standardization=False).fit(rows.coalesce(1))


def score(urls: DataFrame, model, features: int = FEATURES) -> DataFrame:
    """``urls`` (with ``grams``) with ``score``, the probability of being unwanted."""
    if isinstance(model, float):
        return urls.withColumn("score", F.lit(model))
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array
    scored = model.transform(HashingTF(numFeatures=features, binary=True, inputCol="grams",
                                       outputCol=SCORED).transform(urls))
    return scored.withColumn("score", vector_to_array("probability")[1])


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame | None = None) -> DataFrame:
    """Per row: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``score``."""
    urls = with_grams(pages.select("page_id", "url"))
    model = fit(labelled_urls(pages) if labelled is None else labelled)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return (score(urls, model).withColumn("rule", rule)
            .withColumn("verdict", F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")))
            .select("page_id", "host", "path", "rule", "verdict", "score"))
