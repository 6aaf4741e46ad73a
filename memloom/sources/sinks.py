"""Sinks: atomic reports, JSON lines, appended snapshots, table copies and checked exports."""

from __future__ import annotations

import atexit
import json
import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share; a local one only in a local session that
    sets none."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(root or 'file:///tmp/checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder until the interpreter's end, so that it is computed once."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    atexit.register(remove, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_states(spark: SparkSession, paths: list[str]) -> tuple:
    """Path, size and time of change of files."""
    states = []
    for path in sorted(paths):
        fs, target = _fs(spark, path)
        status = fs.getFileStatus(target)
        states.append((path, status.getLen(), status.getModificationTime()))
    return tuple(states)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder; at the interpreter's exit the JVM may be gone, and the folder stays."""
    try:
        fs, target = _fs(spark, path)
        fs.delete(target, True)
    except (OSError, AttributeError, TypeError, Py4JError):
        return


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """One JSON file, complete or absent: written beside its place, then renamed."""
    part = f"{path}.{uuid.uuid4().hex}"
    fs, temporary = _fs(spark, part)
    out = fs.create(temporary, True)
    out.write(bytearray((json.dumps(report, indent=2, ensure_ascii=False) + "\n").encode()))
    out.close()
    _, target = _fs(spark, path)
    if fs.getScheme() == "file":  # replaces in one step
        os.replace(temporary.toUri().getPath(), target.toUri().getPath())
        return
    fs.delete(target, False)  # other stores have no replacing rename
    if not fs.rename(temporary, target):
        raise OSError(f"cannot write {path}")


def write_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def append_snapshot(df: DataFrame, path: str, snapshot_id: int) -> None:
    """One snapshot as one partition; the committer publishes it whole."""
    df.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("append").partitionBy("snapshot_id").parquet(path)


def copy_table(spark: SparkSession, source: str, target: str) -> int:
    """A backup of a table; its rows. The copy is checked against the source before it counts."""
    spark.read.parquet(source).write.mode("error").parquet(target)
    a, b = fingerprint(spark.read.parquet(source)), fingerprint(spark.read.parquet(target))
    if a != b:
        raise OSError("the copy differs from its source")
    return a[0]


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Rows and a checksum that does not depend on their order."""
    row = df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.sum("h")).first()
    return row[0], int(row[1] or 0)


def export_checked(df: DataFrame, path: str, expected_rows: int, hashed: list[str]) -> None:
    """JSON lines with a SHA-256 of some columns; nothing is written unless all rows are there."""
    if (n := df.count()) != expected_rows:
        raise ValueError(f"{n} rows, {expected_rows} expected")
    df.withColumn("sha256", F.sha2(F.to_json(F.struct(*hashed)), 256)).write.mode("error").json(path)


def fetch_pages(fetch: Callable[[int], list[dict]], key: str, size: int = 100, most: int = 100) -> list[dict]:
    """All rows of a paged source, page after page until a short one; a listing that changes under the
    reader (a repeated key), another shape or too many pages give nothing."""
    pages: list[list[dict]] = []
    while not pages or len(pages[-1]) == size:
        if len(pages) == most:
            raise ValueError("too many pages; nothing is kept")
        page = fetch(len(pages) + 1)
        if not isinstance(page, list) or len(page) > size:
            raise ValueError("a page is not a list of rows")
        pages.append(page)
    return merge_pages(pages, key)


def merge_pages(pages: list[list[dict]], key: str) -> list[dict]:
    """Rows of a paged fetch; a repeated key or a short inner page is refused."""
    rows = [r for page in pages for r in page]
    if len({r[key] for r in rows}) != len(rows):
        raise ValueError("a page repeats rows")
    if any(len(p) < len(pages[0]) for p in pages[:-1]):
        raise ValueError("a page is partial")
    return rows
