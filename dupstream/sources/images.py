"""Image files as DataFrames and their fingerprints (SRC1, SRC2, PRJ4, OP6).

* ``image_files``: recursive ``binaryFile`` scan with the reference's
  case-sensitive suffix rule (``None`` = every file; an empty suffix also
  matches every file) plus the content digest (``md5``);
* ``decoded_images``: Spark's ``image`` source decodes in the JVM (no
  imaging library in Python) and drops undecodable files;
* ``fingerprint_images``: ``mapInArrow`` computing the hashes of stacks of
  decoded images of one size (NumPy kernels in ``functions.imagehash``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupstream.functions import imagehash as IH
from dupstream.schemas import WORDS
from dupstream.session import stored

SMALL = ("ahash64", "dhash_h64", "dhash_v64")
FP_SCHEMA = ("path string, " + ", ".join(f"{w} bigint" for w in WORDS)
             + ", ahash64 bigint, dhash_h64 bigint, dhash_v64 bigint, vector768 array<tinyint>")


def _norm_path(col):
    """``file:///x`` and ``file:/x`` name the same file."""
    return F.regexp_replace(col, r"^file:/+", "file:/")


def image_files(spark: SparkSession, path: str, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """SRC1 + FN11: ``path, length, content, crc`` of every matching file."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if extensions and "" not in extensions:
        cond = None
        for ext in extensions:
            c = F.col("path").endswith(ext)
            cond = c if cond is None else cond | c
        df = df.filter(cond)
    return df.select(_norm_path(F.col("path")).alias("path"), "length", "content",
                     F.md5("content").alias("crc"))


def decoded_images(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: decodable images as ``path, height, width, n_channels, data``
    (B, G, R(, A) byte order, row-major)."""
    img = (spark.read.format("image").option("dropInvalid", "true")
           .option("recursiveFileLookup", "true").load(path))
    return img.select(_norm_path(F.col("image.origin")).alias("path"), F.col("image.height").alias("height"),
                      F.col("image.width").alias("width"), F.col("image.nChannels").alias("n_channels"),
                      F.col("image.data").alias("data"))


STACK_BYTES = 16 << 20      # gray pixels hashed at once


def _gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    arr = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return arr[..., 0] if channels == 1 else IH.luma(arr)


def _hashed(paths: list, images: list) -> pa.RecordBatch:
    """Fingerprints of images in order; images of one size are hashed as stacks."""
    n = len(images)
    words, small = np.zeros((n, len(WORDS)), np.int64), {k: np.zeros(n, np.int64) for k in SMALL}
    vector = np.zeros((n, 768), np.int8)
    sizes: dict[tuple, list[int]] = {}
    for i, gray in enumerate(images):
        sizes.setdefault(gray.shape, []).append(i)
    for (h, w), at in sizes.items():
        step = max(1, STACK_BYTES // max(1, h * w))
        for k in range(0, len(at), step):
            part = at[k:k + step]
            got = IH.fingerprints(np.stack([images[i] for i in part]))
            words[part], vector[part] = got["words"], got["vector768"]
            for name in SMALL:
                small[name][part] = got[name]
    columns = [pa.array(paths, pa.string()), *[pa.array(words[:, j]) for j in range(len(WORDS))],
               *[pa.array(small[k]) for k in SMALL],
               pa.ListArray.from_arrays(np.arange(0, 768 * n + 1, 768, dtype=np.int32), pa.array(vector.ravel()))]
    return pa.RecordBatch.from_arrays(columns, names=["path", *WORDS, *SMALL, "vector768"])


def fingerprint_images(decoded: DataFrame) -> DataFrame:
    """FN20-FN25 per decoded image (``path`` + hashes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [batch.column(c).to_pylist() for c in ("data", "height", "width", "n_channels")]
            yield _hashed(batch.column("path").to_pylist(), [_gray(*x) for x in zip(*fields)])
    return decoded.select("path", "height", "width", "n_channels", "data").mapInArrow(run, FP_SCHEMA)


def fingerprint_pixels(grids: DataFrame, key: str, pixels: str, width: int, height: int) -> DataFrame:
    """Fingerprints of gray pixel arrays already in a table (``key`` +
    ``pixels`` ARRAY<INT> of height x width values 0-255)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            px = batch.column("px").flatten().to_numpy(zero_copy_only=False).astype(np.uint8)
            yield _hashed(batch.column("path").to_pylist(), list(px.reshape(batch.num_rows, height, width)))
    rows = grids.select(F.col(key).cast("string").alias("path"), F.col(pixels).alias("px"))
    return rows.mapInArrow(run, FP_SCHEMA)


def post_fingerprints(files: DataFrame, decoded_fp: DataFrame, animated: DataFrame) -> DataFrame:
    """PRJ4: still images get their hashes and bits; animated ones (and
    files that cannot be decoded) zero words, bits 0; all keep the digest.
    ``animated`` holds ``path, animated``."""
    from dupstream.functions.bits import reference_bits, signed_sum_is_zero
    j = files.select("path", "crc").join(animated, "path", "left").join(decoded_fp, "path", "left")
    still = ~F.coalesce(F.col("animated"), F.lit(False)) & F.col("ahash_1").isNotNull()
    words = [F.when(still, F.col(w)).otherwise(F.lit(0).cast("bigint")).alias(w) for w in WORDS]
    out = j.select("path", "crc", still.alias("similarity"), *words)
    return out.select("*", F.when(F.col("similarity"), reference_bits()).otherwise(F.lit(0)).alias("bits"),
                      (F.col("similarity") & signed_sum_is_zero()).alias("rejected"))


def folder_duplicates(spark: SparkSession, path: str, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """OP6: the files under ``path`` that share an exact aHash, dHash_h or dHash_v with
    another one, a row per hash kind: ``kind, h1..h4, n, path``."""
    files = image_files(spark, path, extensions).select("path")
    return duplicate_paths(fingerprint_images(decoded_images(spark, path)).join(files, "path", "left_semi"))


def duplicate_paths(prints: DataFrame) -> DataFrame:
    """Rows of fingerprints (``path`` and the words) that share a hash: ``kind, h1..h4, n, path``."""
    from dupstream.operators.skew import join_back
    from dupstream.operators.stats import stacked_hashes
    rows = stored(stacked_hashes(prints.withColumnRenamed("path", "id")).select(F.col("id").alias("path"),
                                                                                F.struct("kind", "h1", "h2", "h3", "h4").alias("key")), "hashes")
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("n_rows", F.col("n"))
    return join_back(rows, shared, "key", "n_rows").select("key.*", "n", "path")
