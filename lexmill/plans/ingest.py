"""From files to searchable tables, and keeping them so.

Tables of a store, each versioned: sources (files given one by one, with their metadata), parsed (keyed by document and parsing fingerprint), chunked (by
document and the fingerprints of parsing and chunking), chunks (with vectors and the embedder's fingerprint), the text index, which grows by
segments (operators.segments), and documents. A stage works on what its table does not have under the present fingerprints, so files
that did not change are not parsed again, nor are stages before a changed setting run again. Documents come last: until they
are published, a scan finds the same work to do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import ids
from ..functions import metadata as M
from ..functions import text as T
from ..operators import cache, chunking, embedding, markdown, search, segments, sync, textindex
from ..sources import files, tables


@dataclass
class Report:
    """How many documents each stage worked on, and how many it could not parse; of embedding, chunks."""

    parsed: int = 0
    failed: int = 0
    chunked: int = 0
    embedded: int = 0
    summarised: int = 0


def fingerprints(config: Config) -> dict[str, str]:
    """Of each stage with those before it."""
    own = {k: cache.fingerprint(v) for k, v in config.stage_settings().items()}
    chain = lambda *stages: hashlib.sha256("|".join(own[s] for s in stages).encode()).hexdigest()
    return {"parsing": own["parsing"], "chunking": chain("parsing", "chunking"), "embedding": own["embedding"], "summarizer": chain("parsing", "summarizer")}


def everything(spark: SparkSession, root: str, store: str, config: Config) -> DataFrame:
    """(path, checksum, last_modified, file_size, content) of the files below root and of those given one by one; columns that are not used cost nothing."""
    out = files.scan(spark, root, config.supported_extensions)
    sources = tables.read(spark, f"{store}/sources")
    if sources is not None:
        more = files.given(spark, [r.path for r in sources.select("path").collect()])  # files named by hand
        if more is not None:
            out = out.unionByName(more.join(files.listed(out).select("path"), "path", "left_anti"))
    return out


def scanned(spark: SparkSession, root: str, store: str, config: Config, deep: bool = False) -> DataFrame:
    """(document_id, path, checksum, last_modified, file_size, user, seen_at) of all files, written as the store's table of the scan.

    Files are listed, and only those are read whose size or time is not that of the last scan; with ``deep`` all of them.
    """
    files_there = everything(spark, root, store, config)
    listing, old = files.listed(files_there), tables.read(spark, f"{store}/scan")
    if deep or old is None or "seen_at" not in old.columns:
        known = listing.withColumn("checksum", F.lit(None).cast("string"))
    else:
        known = sync.trusted(listing, old)
    read = files.contents(spark, files_there, known.where("checksum is null")).select("path", "last_modified", "file_size", "checksum")
    out = known.where("checksum is not null").unionByName(read).withColumn("seen_at", F.current_timestamp().cast("double"))
    sources = tables.read(spark, f"{store}/sources")
    if sources is not None:
        out = out.join(sources.select("path", F.col("metadata").alias("user")), "path", "left")
    else:
        out = out.withColumn("user", F.lit(None).cast("map<string,string>"))
    tables.publish(out.withColumn("document_id", ids.document_id(F.col("path"), F.col("checksum"))), f"{store}/scan")
    return tables.read(spark, f"{store}/scan")


def parsed_files(found: DataFrame, parser: files.PdfParser = files.missing_parser) -> DataFrame:
    """(document_id, path, title, metadata, body, error) of files (document_id, path, content): Markdown as it is, PDF by the parser. What cannot be parsed is a row with its error."""
    kind = files.route(F.col("path"))
    plain = found.where(kind == "markdown").select("path", files.markdown_text(F.col("content")).alias("text"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("placeholders"))
    pdf = files.with_markers(files.pdf_pages(found.where(kind == "pdf"), parser)).withColumn("placeholders", F.when(F.size("placeholders") > 0, F.to_json("placeholders")))
    other = found.where(kind == "unsupported").select("path", F.lit(None).cast("string").alias("text"), F.concat(F.lit("no parser for "), T.file_suffix(F.col("path"))).alias("error"), F.lit(None).cast("string").alias("placeholders"))
    rows = plain.unionByName(pdf.select(*plain.columns)).unionByName(other)
    out = markdown.parsed(rows).join(found.select("path", "document_id"), "path")
    lost = F.when(F.col("placeholders").isNotNull(), F.create_map(F.lit("placeholder_pages"), F.col("placeholders")))
    meta = F.when(F.col("error").isNotNull(), F.create_map().cast("map<string,string>")).otherwise(F.map_concat("metadata", F.coalesce(lost, F.create_map().cast("map<string,string>"))))
    meta = F.transform_values(meta, lambda k, v: F.when((k == "document_type") & (files.route(F.col("path")) == "pdf"), "pdf").otherwise(v))
    return out.select("document_id", "path", "title", meta.alias("metadata"), F.when(F.col("error").isNull(), F.col("body")).alias("body"), "error")


def identified(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their id (hashed with the document's), page and document metadata."""
    page = F.col("page_number") if "page_number" in chunks.columns else F.lit(None).cast("int")
    own = F.col("headings") if "headings" in chunks.columns else F.create_map().cast("map<string,string>")
    c = chunks.select(
        ids.chunk_id(F.col("document_id"), F.col("chunk_index"), F.col("text"), page).alias("chunk_id"), "document_id", "chunk_index", "text", page.alias("page_number"), own.alias("metadata")
    )
    return c.join(documents.select("document_id", F.col("metadata").alias("document_metadata")), "document_id")


def chunks_of(documents: DataFrame, config: Config | None = None) -> DataFrame:
    """Chunks of documents (document_id, body) by pages, or by a splitter over the pages joined under their numbers."""
    c = config or Config()
    pages = markdown.pages(documents, "body")
    if c.chunker == "page":
        return chunking.page_chunks(pages, c.page_min_chunk_size, c.page_max_chunk_size, c.page_merge_small, c.min_chunk_size)
    joined = chunking.with_page_headers(pages)
    if c.chunker == "semantic":
        out = chunking.semantic_chunks(joined, embedding.with_hashed, c.semantic_threshold, c.semantic_amount, c.semantic_buffer, c.semantic_min_chars)
        return chunking.large_enough(out, c.min_chunk_size)
    size, overlap, split = c.chunk_size, c.chunk_overlap, chunking.chunker(c.chunker)
    if c.chunker != "by_title":
        headers = () if c.chunker == "recursive" else chunking.HEADERS
        split = lambda text: chunking.header_chunks(text, size, overlap, headers=headers)
    out = chunking.chunked(joined, split)
    page = F.coalesce(chunking.recovered_page(F.col("text")), F.try_element_at("headings", F.lit("page")).cast("int"))
    within = Window.partitionBy("document_id").orderBy("chunk_index")  # of one document
    out = out.withColumn("page_number", F.last(page, ignorenulls=True).over(within))
    return chunking.large_enough(out, c.min_chunk_size)


def _stage(spark: SparkSession, root: str, key: str, value: str, there: DataFrame, make: Callable[[DataFrame], DataFrame], partition: str = "document_id") -> tuple[DataFrame, int]:
    """A stage's table for the rows there, and how many of them it had to make: rows it has under the present fingerprint are kept, those of others go.

    The table is published only if rows came or went.
    """
    old = tables.read(spark, root)
    kept = old.where(F.col(key) == value).join(there.select(partition).distinct(), partition, "left_semi") if old is not None else None
    todo = there if kept is None else there.join(kept.select(partition).distinct(), partition, "left_anti")
    n = todo.count()
    if n or old is None or kept.count() != old.count():
        new = make(todo).withColumn(key, F.lit(value))
        tables.publish(new if kept is None else kept.unionByName(new, allowMissingColumns=True), root)
    return tables.read(spark, root), n


def at_most(rows: DataFrame, tasks: int | None) -> DataFrame:
    """rows in at most so many partitions, and so tasks at once; as they are for None."""
    return rows if tasks is None else rows.repartition(tasks)


def ingest(
    spark: SparkSession,
    root: str,
    store: str,
    config: Config | None = None,
    parser: files.PdfParser = files.missing_parser,
    embed: Callable[[DataFrame], DataFrame] = embedding.with_hashed,
    summariser: embedding.Summariser | None = None,
    found: DataFrame | None = None,
) -> tuple[search.Collection, Report]:
    """Scans root and the files given one by one (unless found, a scanned() of them, is there), brings the tables in store up to date, and opens them."""
    c, report = config or Config(), Report()
    prints, at = fingerprints(c), lambda name: f"{store}/{name}"
    found = scanned(spark, root, store, c) if found is None else found  # all stages see the same files; contents are read only to be parsed

    def parse(todo: DataFrame) -> DataFrame:
        read = files.contents(spark, everything(spark, root, store, c), todo)
        given = todo.select("document_id", "path").join(read.select("path", "content"), "path")
        return parsed_files(at_most(given, c.max_parallel_parsing), parser)

    parsed, report.parsed = _stage(spark, at("parsed"), "parsing", prints["parsing"], found, parse)
    good = parsed.where("error is null")
    report.failed = parsed.where("error is not null").count()

    # a document without chunks has one row without text, so that it is not chunked anew
    def chunk(todo: DataFrame) -> DataFrame:
        out = chunks_of(todo.select("document_id", "body"), c)
        page = F.col("page_number") if "page_number" in out.columns else F.lit(None).cast("int")
        own = F.col("headings") if "headings" in out.columns else F.create_map().cast("map<string,string>")
        return todo.select("document_id").join(out.select("document_id", "chunk_index", "text", page.alias("page_number"), own.alias("headings")), "document_id", "left")

    chunked, report.chunked = _stage(spark, at("chunked"), "chunking", prints["chunking"], good, chunk)

    user = found.select("document_id", "user")
    described = good.join(user, "document_id").withColumn("metadata", M.merged(F.coalesce("user", F.create_map().cast("map<string,string>")), F.col("metadata")))
    parts = identified(chunked.where("text is not null"), described).dropDuplicates(["chunk_id"])
    vectors, report.embedded = _stage(
        spark, at("vectors"), "embedding_of", prints["embedding"], parts.select("chunk_id", "text"), lambda todo: embed(at_most(todo, c.max_parallel_embedding)).select("chunk_id", "embedding"), "chunk_id"
    )
    chunks = parts.join(vectors.select("chunk_id", "embedding"), "chunk_id")
    tables.publish(chunks, at("chunks"))
    indexed(spark, at("text"), tables.read(spark, at("chunks")), c.text_analyzer)

    documents = found.drop("user", "seen_at").join(parsed.select("document_id", "title", "body", "error"), "document_id").join(described.select("document_id", "metadata"), "document_id", "left")
    if summariser is not None and c.summarise:
        def summarise(todo: DataFrame) -> DataFrame:
            content = markdown.summary_content(markdown.pages(todo, "body"), c.summary_max_pages)
            rows = todo.select("document_id", "title", T.file_name(F.col("path")).alias("filename")).join(content, "document_id", "left")
            return embedding.summarised(rows, F.col("content"), summariser).select("document_id", F.col("title").alias("summary_title"), "summary")

        summaries, report.summarised = _stage(spark, at("summaries"), "summarizer", prints["summarizer"], good, summarise)
        documents = documents.join(summaries.select("document_id", "summary_title", "summary"), "document_id", "left").withColumn("title", F.coalesce("summary_title", "title")).drop("summary_title")
    before = tables.read(spark, at("documents"))
    added = before.select("document_id", F.col("added_at").alias("since")) if before is not None else spark.createDataFrame([], "document_id string, since timestamp")
    documents = documents.join(added, "document_id", "left").withColumn("added_at", F.coalesce("since", F.current_timestamp())).drop("since")
    tables.publish(documents, at("documents"))
    return open_collection(spark, store), report


def indexed(spark: SparkSession, root: str, chunks: DataFrame, analyzer: str) -> segments.Segments:
    """The text index over chunks (chunk_id, document_id, text): one segment with those it does not have, without those that are not there. Another analyzer begins anew."""
    index = segments.Segments.open(spark, root, analyzer)
    if index.analyzer != analyzer:
        tables.drop(spark, root)
        index = segments.Segments.open(spark, root, analyzer)
    there = index.chunks().select("chunk_id")
    new = chunks.join(there, "chunk_id", "left_anti").select("chunk_id", "document_id", textindex.analysed(F.col("text"), analyzer).alias("terms"))
    gone = there.join(chunks.select("chunk_id"), "chunk_id", "left_anti")
    if not index.rows or new.limit(1).count() or gone.limit(1).count():
        index = index.changed(new, chunks=gone)
    return index


def open_collection(spark: SparkSession, store: str) -> search.Collection:
    """The tables in store, with the text index as it is stored."""
    chunks, documents = tables.read(spark, f"{store}/chunks"), tables.read(spark, f"{store}/documents")

    def query_vector(query: str) -> list[float] | None:
        row = spark.createDataFrame([(query,)], "text string").select(embedding.hashed(F.col("text")).alias("v")).first()
        return list(row.v) if row.v is not None else None

    index = segments.Segments.open(spark, f"{store}/text").text_index()
    return search.Collection(chunks, documents.where("error is null"), index, query_vector)


def removed(spark: SparkSession, store: str, document_id: str) -> search.Collection:
    """Deletes a document from all tables that a search or listing reads; statistics of the text index follow."""
    gone = spark.createDataFrame([(document_id,)], "document_id string")
    path = [r.path for r in tables.read(spark, f"{store}/documents").where(F.col("document_id") == document_id).select("path").collect()]  # one document's
    if tables.current(spark, f"{store}/sources"):
        tables.update(spark, f"{store}/sources", lambda old: old.where(~F.col("path").isin(path)))
    segments.Segments.open(spark, f"{store}/text").changed(documents=gone)
    for name in ("chunks", "documents"):
        tables.update(spark, f"{store}/{name}", lambda old: sync.without_documents(old, gone))
    return open_collection(spark, store)


def add_source(spark: SparkSession, store: str, path: str, metadata: dict[str, str] | None = None) -> None:
    """Notes a file to be ingested wherever it is, with metadata of the user's; given again, the new metadata counts."""
    row = spark.createDataFrame([(path, {k: str(v) for k, v in (metadata or {}).items()})], "path string, metadata map<string,string>")
    tables.update(spark, f"{store}/sources", lambda old: row if old is None else old.where(F.col("path") != path).unionByName(row))
