"""Listings, look-ups and statistics over documents and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import text as T


def list_from_chunks(chunks: DataFrame) -> DataFrame:
    """Documents as their chunks tell: title and path of the first chunk, and the number of chunks."""
    return chunks.groupBy("document_id").agg(
        F.min_by("title", "chunk_index").alias("title"), F.min_by("path", "chunk_index").alias("path"), F.count("*").alias("chunk_count")
    )


def document_count(chunks: DataFrame) -> DataFrame:
    """The number of different document ids that are not empty."""
    return chunks.agg(F.countDistinct(F.nullif("document_id", F.lit(""))).alias("documents"))


def chunk_count(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"))


def document_chunks(chunks: DataFrame, document_id: str) -> DataFrame:
    return chunks.where(F.col("document_id") == document_id).orderBy("chunk_index")


def contents(chunks: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(document_id, content): the chunks of each document in order, joined. A document's chunks make one value."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return chunks.groupBy("document_id").agg(F.concat_ws(separator, F.transform(ordered, lambda x: x["text"])).alias("content"))


def preview(contents_: DataFrame, length: int = 500) -> DataFrame:
    return contents_.select("document_id", F.left("content", F.lit(length)).alias("preview"), (F.length("content") > length).alias("more"))


def chunks_at(chunks: DataFrame, document_id: str, indices: str) -> DataFrame:
    """(chunk_index, text, missing) for a list like '1,2,5': all that were asked for, in order, once each."""
    spark = chunks.sparkSession
    try:
        wanted = sorted({int(x) for x in indices.split(",")})
    except ValueError as e:
        raise ValueError(f"no list of chunk numbers: {indices!r}") from e
    asked = spark.createDataFrame([(x,) for x in wanted], "chunk_index int")
    own = chunks.where(F.col("document_id") == document_id).select("chunk_index", "text")
    return asked.join(own, "chunk_index", "left").withColumn("missing", F.col("text").isNull()).orderBy("chunk_index")


def resolved(documents: DataFrame, identifier: str, root: str = "") -> DataFrame:
    """The document named by an id (doc_...) or by a path, absolute or below root."""
    if identifier.startswith("doc_"):
        return documents.where(F.col("document_id") == identifier)
    path = identifier if identifier.startswith("/") else f"{root.rstrip('/')}/{identifier}"
    return documents.where(F.col("path").isin(path, identifier))


def with_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their chunks nested in order."""
    fields = [c for c in chunks.columns if c != "document_id"]
    nested = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", *[c for c in fields if c != "chunk_index"]))).alias("chunks"))
    return documents.join(nested, "document_id", "left")


def filtered(documents: DataFrame, where: dict | None) -> DataFrame:
    """Documents whose metadata equals the filter; a missing key fails."""
    maps = [F.col("metadata")] if "metadata" in documents.columns else []
    return documents.where(M.predicate(where, {c: t for c, t in documents.dtypes if c != "metadata"}, *maps))


def matching(documents: DataFrame, term: str) -> DataFrame:
    """Documents with the term in title, path or file name, in any case."""
    t = term.lower()
    return documents.where(F.contains(F.lower("title"), F.lit(t)) | F.contains(F.lower("path"), F.lit(t)) | F.contains(F.lower(T.file_name(F.col("path"))), F.lit(t)))


def listed(documents: DataFrame, page: int = 1, size: int = 20) -> tuple[DataFrame, dict]:
    """A page, newest first, and total, total_pages, has_next and has_previous."""
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("pages count from 1 and hold 1 to 100 documents")
    total = documents.count()
    pages = -(-total // size)
    rows = documents.orderBy(F.desc("added_at"), "document_id").offset((page - 1) * size).limit(size)
    return rows, {"total": total, "total_pages": pages, "has_next": page < pages, "has_previous": page > 1}


def with_pending(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Completed documents and those still in work, with their status."""
    done = documents.select("document_id", "path", F.lit("completed").alias("processing_status"))
    return done.unionByName(jobs.where("status <> 'completed'").select(F.lit(None).cast("string").alias("document_id"), "path", F.col("status").alias("processing_status")))


def statistics(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks, chunks per document to two places."""
    d, c = documents.agg(F.count("*").alias("documents")), chunks.agg(F.count("*").alias("chunks"))
    return d.join(c).select("documents", "chunks", F.coalesce(F.round(F.col("chunks") / F.nullif("documents", F.lit(0)), 2), F.lit(0.0)).alias("chunks_per_document"))


def by_type(documents: DataFrame, column: str = "document_type") -> DataFrame:
    return documents.groupBy(F.coalesce(F.col(column), F.lit("pdf")).alias("document_type")).agg(F.count("*").alias("documents"))


def storage(files: DataFrame) -> DataFrame:
    """Number and size of files; MB to two places."""
    total = F.coalesce(F.sum("file_size"), F.lit(0))
    return files.agg(F.count("*").alias("files"), total.alias("bytes"), F.round(total / 1048576, 2).alias("megabytes"))


def processing(file_index: DataFrame, today: Column | None = None) -> DataFrame:
    """Processed files, the latest time, and how many were processed on a day (today by default)."""
    day = F.current_date() if today is None else today
    return file_index.agg(
        F.count("processed_time").alias("processed"), F.max("processed_time").alias("latest"), F.count_if(F.to_date("processed_time") == day).alias("processed_on_day")
    )


def throughput(documents: DataFrame) -> DataFrame:
    """Documents an hour between the first and last added; 0 if there is no time between."""
    hours = (F.max("added_at").cast("double") - F.min("added_at").cast("double")) / 3600
    return documents.agg(F.count("*").alias("documents"), F.coalesce(F.round(F.count("*") / F.nullif(hours, F.lit(0.0)), 2), F.lit(0.0)).alias("documents_per_hour"))


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("jobs"))


def index_listing(file_index: DataFrame) -> DataFrame:
    return file_index.select("path", "checksum", F.col("processed_time").isNotNull().alias("processed"))


def listed_all(documents: DataFrame) -> DataFrame:
    """(document_id, path, title, total) of all documents; the total is one row, joined to each."""
    return documents.select("document_id", "path", "title").join(F.broadcast(documents.agg(F.count("*").alias("total"))))


def result_csv(results: DataFrame) -> DataFrame:
    """Results as the six columns of the CSV export: scores in percent, chunk numbers from 1."""
    return results.select(
        F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")).alias("Document Title"),
        F.col("path").alias("Document Path"),
        F.format_string("%.2f%%", F.col("score") * 100).alias("Score"),
        F.when(F.col("page_number") != 0, F.col("page_number").cast("string")).alias("Page"),
        (F.col("chunk_index") + 1).alias("Chunk Index"),
        F.col("text").alias("Content"),
    )


def write_csv(results: DataFrame, path: str) -> None:
    result_csv(results).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON object, times in ISO 8601 UTC."""
    return rows.select(F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX", "ignoreNullFields": "false"}).alias("json"))


def latest_per_key(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(order.desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
