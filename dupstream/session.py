"""Spark session helpers.

Library code never creates a session on its own; callers pass one in.  The
helpers here give tests and ``bench.py`` a session configured the way the
operators expect (AQE with skew-join splitting, UTC, no UI) and resolve the
shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on.  ``spark.sql.adaptive.*`` lets Spark split a
# skewed band/class partition at run time and coalesce tiny shuffle outputs.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Fingerprint plans carry many bitwise predicates over twelve word
    # columns; constraint inference over them grows combinatorially.
    "spark.sql.constraintPropagation.enabled": "false",
    # Let "row_number() <= 1024" per group run as a partial per-partition
    # limit before the shuffle (default threshold is 1000).
    "spark.sql.optimizer.windowGroupLimitThreshold": "4096",
}


def prepare(spark: SparkSession) -> None:
    """Runtime settings the heavy operators need on any session (a
    cluster session built elsewhere included), and the package shipped to
    the Python workers."""
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "4096")
    # Rows with whole texts or images are large: small Arrow batches keep the
    # memory of Python workers low.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    ship_package(spark)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``dupstream`` importable in Python workers (pandas UDFs and
    ``mapInPandas`` functions are pickled by reference to their module).

    The package is zipped in memory, written through the Hadoop file system
    into the session's checkpoint folder (shared on a cluster) and added
    with ``addPyFile`` once per application.  Jobs submitted with
    ``--py-files`` already have it; adding it again is harmless.
    """
    import hashlib
    import io
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    data = buf.getvalue()
    digest = hashlib.sha1(data).hexdigest()[:12]
    target = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pyfiles-{digest}/dupstream.zip"
    _put(spark, target, data)
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def ship_jar(spark: SparkSession, files: dict[str, bytes]) -> None:
    """Make compiled classes (name in the jar -> bytes) loadable on every executor, by a jar in
    the checkpoint folder."""
    import hashlib
    import io
    import zipfile

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            z.writestr(name, files[name])
    digest = hashlib.sha1(b"".join(files[n] for n in sorted(files))).hexdigest()[:12]
    target = f"{ensure_checkpoint_dir(spark).rstrip('/')}/jars-{digest}/dupstream-{digest}.jar"
    _put(spark, target, buf.getvalue())
    spark.sparkContext._jsc.addJar(target)


def _put(spark: SparkSession, target: str, data: bytes) -> None:
    """Write a file by Spark's file systems unless it is there."""
    fs, path = path_of(spark, target)
    if not fs.exists(path):
        out = fs.create(path, True)
        out.write(bytearray(data))
        out.close()


MAX_SHUFFLE_PARTITIONS = 100_000


def cluster_settings(input_bytes: int, cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Sizing for a large cluster: enough shuffle partitions that each holds
    about ``target_partition_bytes`` of the widest shuffle (the band join
    explodes each fingerprint row about 18 times; beyond
    ``MAX_SHUFFLE_PARTITIONS`` partitions grow instead), AQE coalescing down to
    that size, skew splitting above 4x it, and scan splits of the same size.
    """
    band_bytes = input_bytes * 18
    partitions = max(2 * cores, -(-band_bytes // target_partition_bytes))
    if partitions > MAX_SHUFFLE_PARTITIONS:
        # past this count scheduling and shuffle-file overheads dominate:
        # keep the count and let partitions grow instead
        target_partition_bytes = -(-band_bytes // MAX_SHUFFLE_PARTITIONS)
        partitions = MAX_SHUFFLE_PARTITIONS
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    }


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "dupstream", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def path_of(spark: SparkSession, path: str):
    """(file system, path) of a folder that only Spark's file systems may reach."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name under the session's checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back:
    several branches of a plan start from files that survive the loss of any
    executor."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is.  Only when it is unset (tests, local runs) a fresh scratch folder
    is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="dupstream-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()
