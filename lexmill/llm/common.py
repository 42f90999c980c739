"""Scratch tables in the shared folder, and file access for executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one is set in local mode, where driver and executors are one; on a cluster that is an error."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexmill-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_OWNED: set[str] = set()


def run_folder(spark: SparkSession) -> str:
    """Where this application's scratch tables and archives are; it goes when the driver ends, or by drop_all()."""
    path = f"{shared_folder(spark)}/lexmill/{spark.sparkContext.applicationId}"
    if path not in _OWNED:
        _OWNED.add(path)
        fs, p = _hadoop(spark, path)
        fs.mkdirs(p)  # only what is there is noted
        fs.deleteOnExit(p)
    return path


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def drop_all(spark: SparkSession) -> None:
    """Deletes what the operators of this application wrote to the shared folder; tables they returned can no longer be read."""
    fs, p = _hadoop(spark, run_folder(spark))
    fs.delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexmill_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes tables made by saved() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_lexmill_path", None)
        if path:
            fs, p = _hadoop(df.sparkSession, path)
            fs.delete(p, True)


#: Most rows, and about how many bytes, that go to a Python worker at once: texts can be long, and a worker holds a batch more than once.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """df; from now on the session sends Python workers at most BATCH_ROWS rows and about BATCH_BYTES bytes at once.

    Spark reads both settings when a plan runs, which is after this returns, so they stay; settings that are lower are kept.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_ROWS)) <= BATCH_ROWS:
        conf.set(_ROWS, str(BATCH_ROWS))
    given = conf.get(_BYTES, None)
    if not (given and given.isdigit() and 0 < int(given) <= BATCH_BYTES):
        conf.set(_BYTES, str(BATCH_BYTES))
    return df


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a folder that executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


#: Most ids that are broadcast to filter a table (about 64 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def fresh() -> str:
    """A column name that no table has."""
    return f"_{uuid.uuid4().hex}"


def without(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of docs whose id is not in ids, a written table of one column; rows with a null id stay."""
    name = fresh()
    dropped = ids.select(ids[0].alias(name)).where(F.col(name).isNotNull()).distinct()
    if ids.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, docs[column] == F.col(name), "left_anti")
