"""Captured API pages as a paged data source, batch and stream (SRC3).

A capture folder holds ``chunk=<n>/`` folders of Parquet files (``page``, ``body``) with
``PAGES_PER_CHUNK`` page numbers each.  The offset of a stream is the next page to read:
a restart goes on with the pages that came after it, and a chunk is opened only when
its page numbers fall into the range asked for.  As when paging through the site, pages are
taken to arrive in order of their number; a page captured below the offset is not read.
A partition is a chunk (in a stream, ``pagesPerTask`` pages of it), read in Arrow batches with
the range pushed to the file; a micro-batch takes all pages that have come.

    spark.dataSource.register(PageSource)
    spark.read.format("captured_pages").option("path", folder).option("from", 10).option("upto", 20).load()
    spark.readStream.format("captured_pages").option("path", folder).option("pagesPerTask", 500).load()

The folder is opened with pyarrow's file systems (local, ``hdfs://``, ``s3://`` and the like).
An empty or missing folder has no pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PAGES_PER_CHUNK = 1_000
SCHEMA = "page bigint, body string"


def capture(pages: DataFrame, folder: str) -> None:
    """Append pages (``page``, ``body``) to a capture folder."""
    (pages.select("page", "body", F.floor(F.col("page") / PAGES_PER_CHUNK).cast("bigint").alias("chunk"))
     .repartition("chunk").sortWithinPartitions("chunk", "page").write.mode("append").partitionBy("chunk").parquet(folder))


def _open(folder: str):
    from pyarrow import fs
    if "://" in folder or folder.startswith("file:"):
        if folder.startswith("file:"):
            folder = "/" + folder[len("file:"):].lstrip("/")
            return fs.LocalFileSystem(), folder
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def _chunks(folder: str) -> dict[int, str]:
    """Chunk number -> folder."""
    from pyarrow import fs
    system, path = _open(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return {int(i.base_name[6:]): i.path for i in found if i.type == fs.FileType.Directory and i.base_name.startswith("chunk=")}


def _files(system, path: str) -> list[str]:
    from pyarrow import fs
    return [i.path for i in system.get_file_info(fs.FileSelector(path)) if i.path.endswith(".parquet")]


def _end(folder: str) -> int:
    """One more than the largest page number, from the footers of the last chunk."""
    import pyarrow.parquet as pq
    chunks = _chunks(folder)
    if not chunks:
        return 0
    system, _ = _open(folder)
    largest = -1
    for f in _files(system, chunks[max(chunks)]):
        meta = pq.ParquetFile(system.open_input_file(f)).metadata
        at = meta.schema.to_arrow_schema().get_field_index("page")
        for g in range(meta.num_row_groups):
            largest = max(largest, meta.row_group(g).column(at).statistics.max)
    return largest + 1


class PageRange(InputPartition):
    """Pages ``start`` to ``end`` (exclusive) of one chunk's folder."""

    def __init__(self, folder: str, path: str, start: int, end: int):
        self.folder, self.path, self.start, self.end = folder, path, start, end


def _ranges(folder: str, start: int, end: int) -> list[PageRange]:
    return [PageRange(folder, path, max(start, c * PAGES_PER_CHUNK), min(end, (c + 1) * PAGES_PER_CHUNK))
            for c, path in sorted(_chunks(folder).items())
            if c * PAGES_PER_CHUNK < end and start < (c + 1) * PAGES_PER_CHUNK]


def _read(part: PageRange):
    import pyarrow as pa
    import pyarrow.dataset as ds
    system, _ = _open(part.folder)
    schema = pa.schema([("page", pa.int64()), ("body", pa.string())])
    data = ds.dataset(_files(system, part.path), schema=schema, filesystem=system, format="parquet")
    number = ds.field("page")
    yield from data.to_batches(filter=(number >= part.start) & (number < part.end), batch_size=100)


class _BatchReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.start = options["path"], int(options.get("from", 0))
        self.upto = int(options["upto"]) if "upto" in options else None

    def partitions(self):
        return _ranges(self.folder, self.start, _end(self.folder) if self.upto is None else self.upto)

    def read(self, partition):
        yield from _read(partition) if partition is not None else ()


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.start = options["path"], int(options.get("from", 0))
        self.step = int(options.get("pagesPerTask", PAGES_PER_CHUNK))

    def initialOffset(self):
        return {"next": self.start}

    def latestOffset(self):
        return {"next": max(self.start, _end(self.folder))}

    def partitions(self, start, end):
        """One partition for each ``pagesPerTask`` pages of a chunk."""
        return [PageRange(p.folder, p.path, a, min(a + self.step, p.end))
                for p in _ranges(self.folder, start["next"], end["next"]) for a in range(p.start, p.end, self.step)]

    def read(self, partition):
        yield from _read(partition)


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captured_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _BatchReader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)
