"""Keeping tables in step with files: snapshot differences, delta application, guarded deletes, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE_SECONDS = 1.0


def new_files(scan: DataFrame, index: DataFrame) -> DataFrame:
    return scan.join(index.select("path"), "path", "left_anti")


def deleted_files(scan: DataFrame, index: DataFrame) -> DataFrame:
    return index.join(scan.select("path"), "path", "left_anti")


def is_modified(new_size: Column, old_size: Column, new_time: Column, old_time: Column, new_sum: Column, old_sum: Column) -> Column:
    return (new_size != old_size) | (F.abs(new_time - old_time) > TOLERANCE_SECONDS) | ~new_sum.eqNullSafe(old_sum)


def modified_files(scan: DataFrame, index: DataFrame) -> DataFrame:
    """Files in both whose size differs, or time by more than a second, or checksum."""
    s, i = scan.alias("s"), index.alias("i")
    changed = is_modified(F.col("s.file_size"), F.col("i.file_size"), F.col("s.last_modified"), F.col("i.last_modified"), F.col("s.checksum"), F.col("i.checksum"))
    return s.join(i, F.col("s.path") == F.col("i.path")).where(changed).select("s.*")


def changes(scan: DataFrame, index: DataFrame) -> DataFrame:
    """(path, change) of all three kinds by one full outer join."""
    s = scan.select("path", F.struct("file_size", "last_modified", "checksum").alias("s"))
    i = index.select("path", F.struct("file_size", "last_modified", "checksum").alias("i"))
    modified = is_modified(F.col("s.file_size"), F.col("i.file_size"), F.col("s.last_modified"), F.col("i.last_modified"), F.col("s.checksum"), F.col("i.checksum"))
    kind = F.when(F.col("i").isNull(), "new").when(F.col("s").isNull(), "deleted").when(modified, "modified")
    return s.join(i, "path", "full_outer").select("path", kind.alias("change")).where("change is not null")


#: A file that changed so shortly before it was looked at may have changed again within the same tick of the clock.
RACY_SECONDS = 2.0


def trusted(listing: DataFrame, index: DataFrame) -> DataFrame:
    """listing (path, last_modified, file_size) with ``checksum``: the one that index (path, last_modified, file_size, checksum, seen_at) has for a file of the same size and time, else null.

    Rows without a checksum are suspects: only those files need be read. A file that was written less than RACY_SECONDS before it was seen is always one.
    """
    i = index.where(F.col("last_modified") < F.col("seen_at") - RACY_SECONDS).select("path", "last_modified", "file_size", "checksum")
    return listing.join(i, ["path", "last_modified", "file_size"], "left")


def change_summary(changed: DataFrame) -> DataFrame:
    """One row with the number of new, modified and deleted files."""
    return changed.agg(*[F.count_if(F.col("change") == k).alias(k) for k in ("new", "modified", "deleted")])


def known_documents(scan: DataFrame, documents: DataFrame) -> DataFrame:
    """Scanned files that are documents already, with their id: what back-fills an index."""
    return scan.join(documents.select("path", "document_id"), "path")


def inserted(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks that are not stored yet, one for each id."""
    return chunks.dropDuplicates(["chunk_id"]).join(stored.select("chunk_id"), "chunk_id", "left_anti")


def without_documents(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of all documents but those in gone (document_id)."""
    return rows.join(gone.select("document_id").distinct(), "document_id", "left_anti")


def applied(stored: DataFrame, delta: DataFrame, changed: DataFrame, documents: DataFrame) -> DataFrame:
    """The table after a sync: rows of deleted and modified paths' documents go, the delta's new rows come."""
    gone = documents.join(changed.where("change in ('deleted', 'modified')").select("path"), "path", "left_semi")
    kept = without_documents(stored, gone)
    return kept.unionByName(inserted(delta, kept))


def deletable(documents: DataFrame, root: str, existing: DataFrame) -> DataFrame:
    """Adds may_delete: not for a file below root, outside uploads, that still exists."""
    below = F.col("path").startswith(root.rstrip("/") + "/")
    uploaded = F.col("path").startswith(root.rstrip("/") + "/uploads/")
    there = documents.join(existing.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left")
    return there.withColumn("may_delete", ~(below & ~uploaded & F.coalesce("_there", F.lit(False)))).drop("_there")


def reconciliation(store: DataFrame, cache: DataFrame) -> DataFrame:
    """(document_id, side): ids in the store only or in the cache only."""
    s = store.select("document_id").distinct().withColumn("s", F.lit(1))
    c = cache.select("document_id").distinct().withColumn("c", F.lit(1))
    out = s.join(c, "document_id", "full_outer").withColumn("side", F.when(F.col("c").isNull(), "store_only").when(F.col("s").isNull(), "cache_only"))
    return out.where("side is not null").select("document_id", "side")


def first_seen(rows: DataFrame, key: str, rank: str) -> DataFrame:
    """Distinct keys in the order of their first rank."""
    return rows.groupBy(key).agg(F.min(rank).alias(rank)).orderBy(rank)
