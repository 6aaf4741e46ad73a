"""Shared plumbing of the training-data operators: scratch tables, shipping, row packing."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space that separates words; bytes.split() without arguments uses the same set.
WORD_SPACE = b" \t\n\x0b\x0c\r"
WORD_REGEX = r"[^\x20\x09-\x0D]+"
#: UTF-8 bytes that one block of rows holds at most (a single longer text is a block of its own).
BLOCK_BYTES = 2 << 20

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: set[str] = set()


def _bytes(setting: str) -> int:
    """A setting's size in bytes, as 64MB or 2097152b."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", setting.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def ship(spark: SparkSession) -> None:
    """Give executors this package, so that a cluster needs no installation of it, and bound the
    bytes of the batches that go to Python."""
    if _bytes(spark.conf.get(_BATCH)) > BLOCK_BYTES:  # a smaller bound of the caller's stays
        spark.conf.set(_BATCH, str(BLOCK_BYTES))  # else 10,000 rows, however long their texts
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = Path(tempfile.mkdtemp(prefix="memloom-ship-"))
    target = folder / "memloom_ship.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, f"{root.name}/{path.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder; one of this machine's only in a local session that names none."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        root = "file:///tmp/checkpoints"
    if "://" not in root:  # a plain path is the default file system's, for Python's writers too
        target = spark._jvm.org.apache.hadoop.fs.Path(root)
        whole = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()
        root = re.sub("^file:/*", "file:///", whole)
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; earlier ones can be dropped."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/memloom-{label}-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, self.base)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Writes `df` and reads it back; the shuffle files of the write go with its end."""
        path = self.path(f"{name}-{uuid.uuid4().hex[:8]}")
        schema = df.schema
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(schema).parquet(path)
        out._memloom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_memloom_path", None)
        if path:
            _remove(self.spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # at interpreter exit the JVM may be gone
        if path.startswith("file:"):
            shutil.rmtree(re.sub("^file:/*", "/", path), ignore_errors=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt over all cores if it has fewer splits than those, as one small file has."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The batch's texts; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def blocks(batches: Iterable[pa.RecordBatch], name: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one piece stay near `limit` bytes."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name))
        if batch.num_rows == 0 or column.nbytes <= limit:
            yield batch
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def set_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    i = batch.schema.get_field_index(name)
    arrays = list(batch.columns)
    arrays[i] = values.cast(batch.schema.field(i).type)
    return pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
