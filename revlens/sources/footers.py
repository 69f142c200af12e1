"""Provenance of every Parquet file of a set, read by tasks (SRC-7).

One footer says nothing about the files beside it: a set may have been appended to by another version or
hold files of another tool. Each task opens the footers of its share of the files (a few kB each, no data
pages) and what is equal is counted by Spark, so the driver gets one row per distinct provenance, with
its files and rows, however many files there are. Stores that Python on the executors can't open are
read through Spark's own Parquet library by the driver, several files at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.schema import META_KEYS

FILES_PER_TASK = 64
SPARK_ROWS = "org.apache.spark.sql.parquet.row.metadata"  # fixed: where Spark keeps its schema as JSON
_COLUMNS = ", ".join(f"{k} string" for k in META_KEYS)


def _reader(keys: tuple[str, ...], spark_rows: str):
    """The function run in tasks. All it needs is inside, so executors need pyarrow but not this package."""

    def provenance(stored: dict[bytes, bytes]) -> dict[str, str]:
        import json

        if spark_rows.encode() in stored:
            for field in json.loads(stored[spark_rows.encode()]).get("fields", []):
                if found := (field.get("metadata") or {}).get("revlens"):
                    return found
        return {k: stored[k.encode()].decode() for k in keys if k.encode() in stored}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        for b in batches:
            out = []
            for uri in b.column(0).to_pylist():
                try:
                    system, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
                    with system.open_input_file(path) as f:
                        meta = pq.read_metadata(f)
                    found = provenance(meta.metadata or {})
                    out.append([*(found.get(k) for k in keys), meta.num_rows, None])
                except (OSError, ValueError, ImportError, NotImplementedError):
                    out.append([*(None for _ in keys), None, uri])
            kinds = [pa.string()] * len(keys) + [pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds],
                                             names=[*keys, "n_rows", "unread"])

    return run


def _through_spark(spark: SparkSession, uri: str) -> tuple:
    """Provenance and rows of one file by Spark's own Parquet library, wherever Spark reads."""
    import json

    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri)), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        stored = reader.getFooter().getFileMetaData().getKeyValueMetaData()
        found = {k: stored.get(k) for k in META_KEYS}
        for field in json.loads(stored.get(SPARK_ROWS) or "{}").get("fields", []):
            found = (field.get("metadata") or {}).get("revlens") or found
        return (*(found.get(k) for k in META_KEYS), reader.getRecordCount())
    finally:
        reader.close()


def provenance_of_files(spark: SparkSession, files: list[str], tasks_only: bool = False) -> DataFrame:
    """(data_version, description, since, until, n_files, n_rows): a row per distinct provenance of ``files``,
    nulls where a footer doesn't say. ``tasks_only`` raises where a file can't be opened by the executors."""
    tasks = max(1, -(-len(files) // FILES_PER_TASK))
    paths = spark.createDataFrame([(f,) for f in sorted(files)], "uri string")
    paths = paths.repartition(tasks) if tasks > 1 else paths.coalesce(1)
    facts = paths.mapInArrow(_reader(tuple(META_KEYS), SPARK_ROWS), f"{_COLUMNS}, n_rows long, unread string")
    found = facts.groupBy(*META_KEYS, "unread").agg(F.count("*").alias("n_files"), F.sum("n_rows").alias("n_rows"))
    rows = found.collect()  # one a distinct provenance, and one a file that was not read
    unread = [r.unread for r in rows if r.unread is not None]
    if unread and tasks_only:
        raise OSError(f"{len(unread)} files can't be opened by the executors, the first is {unread[0]}")
    facts = [(tuple(r[k] for k in META_KEYS), r.n_files, r.n_rows) for r in rows if r.unread is None]
    with ThreadPoolExecutor(8) as pool:
        facts += [(x[:-1], 1, x[-1]) for x in pool.map(lambda uri: _through_spark(spark, uri), unread)]
    every: dict[tuple, tuple[int, int]] = {}
    for key, n, many in facts:
        every[key] = (every.get(key, (0, 0))[0] + n, every.get(key, (0, 0))[1] + many)
    return spark.createDataFrame([(*k, *v) for k, v in every.items()], f"{_COLUMNS}, n_files long, n_rows long")
