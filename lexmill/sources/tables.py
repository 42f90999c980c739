"""Versioned Parquet tables: each write is a new directory, and the pointer of the highest number names the present one.

A path that is being read is never overwritten; a reader keeps the version that it opened. A pointer is a file named by its number alone, created only if it is not
there, that holds the name of its version. So of two writers that start from one version one gets the next number; the other has a
Conflict, and ``update`` makes its change again on what is there then. A pointer without content is a write that has not ended, or never will: readers take
the one before it, and writers wait ``PATIENCE`` seconds for it. The version before the present one stays for its readers, older ones are deleted.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"
KEPT = 2
PATIENCE = 5.0


class Conflict(RuntimeError):
    """Another writer published first."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def children(spark: SparkSession, root: str) -> list[str]:
    fs, path = _fs(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(path(root))) if fs.exists(path(root)) else []


def _numbers(spark: SparkSession, root: str) -> list[int]:
    return [int(n.split(".")[1]) for n in children(spark, root) if n.startswith(f"{POINTER}.") and not n.endswith(".crc")]


def _pointer(root: str, number: int) -> str:
    return f"{root}/{POINTER}.{number:012d}"


def _version(spark: SparkSession, root: str, number: int) -> str:
    """The version that a pointer names; empty if it is not written (or gone)."""
    fs, path = _fs(spark, root)
    at = path(_pointer(root, number))
    if not fs.exists(at):
        return ""
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _present(spark: SparkSession, root: str) -> tuple[int | None, str | None]:
    for number in reversed(_numbers(spark, root)):
        if name := _version(spark, root, number):
            return number, f"{root}/{name}"
    return None, None


def current(spark: SparkSession, root: str) -> str | None:
    return _present(spark, root)[1]


def numbered(spark: SparkSession, root: str) -> tuple[int | None, DataFrame | None]:
    """The present version with its number, which publish() takes as its base."""
    number, path = _present(spark, root)
    return number, spark.read.parquet(path) if path else None


def read(spark: SparkSession, root: str) -> DataFrame | None:
    return numbered(spark, root)[1]


def _claimed(spark: SparkSession, root: str, number: int, name: str) -> bool:
    """Writes the pointer of that number, if it is not there."""
    fs, path = _fs(spark, root)
    try:
        out = fs.create(path(_pointer(root, number)), False)
    except Exception as e:
        if "already exists" in str(e) or "FileAlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(name.encode()))
    out.close()
    return True


def publish(df: DataFrame, root: str, partition_by: list[str] | None = None, base: int | None = None) -> int:
    """Writes a new version and makes it the present one; its number. With a base (-1 for no version), only if that is still the present one."""
    spark = df.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/{name}")
    fs, path = _fs(spark, root)
    until = time.monotonic() + PATIENCE
    while True:
        last = max(_numbers(spark, root), default=-1)
        if last >= 0 and not _version(spark, root, last) and time.monotonic() < until:
            time.sleep(0.1)  # someone is writing it
            continue
        if base is not None and (_present(spark, root)[0] if last >= 0 else None) != (base if base >= 0 else None):
            break
        if _claimed(spark, root, last + 1, name):
            for old in _numbers(spark, root)[:-KEPT]:
                gone = _version(spark, root, old)
                fs.delete(path(_pointer(root, old)), False)
                if gone:
                    fs.delete(path(f"{root}/{gone}"), True)
            return last + 1
    fs.delete(path(f"{root}/{name}"), True)
    raise Conflict(root)


def update(spark: SparkSession, root: str, change: Callable[[DataFrame | None], DataFrame]) -> int:
    """Publishes change(present version), again if another writer came first."""
    while True:
        number, old = numbered(spark, root)
        try:
            return publish(change(old), root, base=-1 if number is None else number)
        except Conflict:
            continue


def drop(spark: SparkSession, root: str) -> None:
    fs, path = _fs(spark, root)
    fs.delete(path(root), True)


def to_record(row: dict) -> str:
    """A row as JSON with sorted keys."""
    return json.dumps(row, sort_keys=True, default=str, ensure_ascii=False)
