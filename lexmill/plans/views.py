"""Documents and chunks as the queries see them, from the driver's tables; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import search, textindex


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/kb/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    d = d.withColumns({"path": path, "checksum": F.sha2("text", 256), "title": F.left(F.get(F.split("text", "\n"), F.lit(0)), F.lit(60))})
    return d.withColumns(
        {
            "document_id": ids.document_id(F.col("path"), F.col("checksum")),
            "metadata": F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("n_chars"), F.col("n_chars").cast("string")),
            "added_at": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60),
        }
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each line of a document."""
    d = documents(spark, sf_dir).select("doc_id", "document_id", "path", "title", "lang", "source", F.col("metadata").alias("document_metadata"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    page = F.lit(None).cast("int")
    return d.withColumns({"page_number": page, "chunk_id": ids.chunk_id(F.col("document_id"), F.col("chunk_index"), F.col("text"), page), "metadata": F.create_map().cast("map<string,string>")})


def collection(spark: SparkSession, sf_dir: str, settings: search.Settings | None = None) -> search.Collection:
    """Whole documents as chunks, with the vectors whose id is theirs; documents without a vector are found by text only."""
    d = documents(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    c = d.join(e, "doc_id", "left").select(
        F.format_string("c%06d", "doc_id").alias("chunk_id"), "document_id", F.lit(0).alias("chunk_index"), F.lit(None).cast("int").alias("page_number"), "text", "embedding", "lang", "source",
        F.col("metadata").alias("document_metadata"), F.create_map().cast("map<string,string>").alias("metadata"),
    )
    return search.Collection(c, d.select("document_id", "path", "title", "metadata", "added_at"), textindex.TextIndex.build(c), None, settings or search.Settings())


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first().embedding


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)

SQL_DOCUMENTS = """d AS (
  SELECT *, 'doc_' || left(sha256(path || '|' || checksum), 16) AS document_id FROM (
    SELECT *, '/kb/' || source || '/' || doc_id || '.md' AS path, sha256(text) AS checksum, left(split_part(text, chr(10), 1), 60) AS title FROM documents))"""
SQL_CHUNKS = SQL_DOCUMENTS + """,
c AS (
  SELECT *, 'chunk_' || left(sha256(document_id || '|' || chunk_index || '|' || text || '|None'), 16) AS chunk_id FROM (
    SELECT doc_id, document_id, path, title, lang, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_index FROM d))"""
SQL_COLLECTION = SQL_DOCUMENTS + """,
c AS (
  SELECT printf('c%06d', doc_id) AS chunk_id, document_id, path, title, lang, source, n_chars, text, embedding, doc_id
  FROM d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""


def sql_tokens(expression: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({expression}), '[\p{{L}}\p{{N}}_]+(?:\.?[\p{{L}}\p{{N}}_]+)*'), lambda x: len(x) > 1 AND x NOT IN ({_STOP}))"


def sql_bm25(terms: list[str], name: str = "t", every: bool = True, condition: str = "true") -> str:
    """CTEs ending in ``name`` (chunk_id, document_id, score) of all matches, from c (chunk_id, document_id, text)."""
    listed = ", ".join(f"'{t}'" for t in terms)
    having = f"HAVING count(*) = {len(set(terms))}" if every else ""
    return f"""{name}_tok AS (SELECT *, {sql_tokens('text')} AS terms FROM c),
{name}_st AS (SELECT count(*) AS n, avg(len(terms)) AS ml FROM {name}_tok),
{name}_p AS (SELECT chunk_id, document_id, len(terms) AS length, unnest(terms) AS term FROM {name}_tok),
{name}_h AS (SELECT term, chunk_id, document_id, length, count(*) AS tf FROM {name}_p WHERE term IN ({listed}) GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_h GROUP BY term),
{name} AS (SELECT chunk_id, document_id, round(sum((ln(n / (df + 1)) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / ml))), 6) AS score
  FROM {name}_h JOIN {name}_df USING (term), {name}_st GROUP BY chunk_id, document_id {having})"""


def sql_vector(vec_id: int, name: str = "v", condition: str = "true") -> str:
    return f"""{name} AS (SELECT chunk_id, document_id, round(greatest(0, 1 - raw / 2), 6) AS score, round(raw, 6) AS distance FROM (
  SELECT c.chunk_id, c.document_id, list_sum(list_transform(list_zip(c.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS raw
  FROM c, (SELECT embedding FROM embeddings WHERE vec_id = {vec_id}) q WHERE c.embedding IS NOT NULL AND {condition}))"""
