"""Markdown documents: front matter, pages by markers, page tables."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MARKER = r"--\[PAGE:\s*(\d+)\]--"
YAML = r"(?s)\A---\s*\n(.*?)\n---\s*\n"
TOML = r"(?s)\A\+\+\+\s*\n(.*?)\n\+\+\+\s*\n"


def front_matter(text: Column) -> Column:
    """struct(kind, raw, body) by form alone: yaml, toml or null; what is left of the text."""
    yaml, toml = text.rlike(YAML), text.rlike(TOML)
    return F.struct(
        F.when(yaml, "yaml").when(toml, "toml").alias("kind"),
        F.when(yaml, F.regexp_extract(text, YAML, 1)).when(toml, F.regexp_extract(text, TOML, 1)).alias("raw"),
        F.when(yaml, F.regexp_replace(text, YAML, "")).when(toml, F.regexp_replace(text, TOML, "")).otherwise(text).alias("body"),
    )


def _plain(value):
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, (set, frozenset)):
        return sorted(map(_plain, value), key=str)
    if isinstance(value, datetime.datetime):
        return (value if value.tzinfo else value.replace(tzinfo=datetime.timezone.utc)).astimezone(datetime.timezone.utc).isoformat()
    if isinstance(value, (datetime.date, datetime.time)):
        return value.isoformat()
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


def _decoded(kind: str | None, raw: str | None) -> dict | None:
    """The fields of a front matter; None if it does not parse."""
    if kind is None:
        return None
    try:
        if kind == "yaml":
            import yaml

            value = yaml.safe_load(raw) or {}
        else:
            import tomllib

            value = tomllib.loads(raw)
    except Exception:  # whatever a parser makes of a text that is none
        return None
    return {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in _plain(value).items()} if isinstance(value, dict) else None


def decoded(kind: Column | str, raw: Column | str) -> Column:
    """The fields of a front matter as a map; null if it does not parse."""

    @F.pandas_udf("map<string,string>")
    def run(kinds: pd.Series, raws: pd.Series) -> pd.Series:
        return pd.Series([_decoded(k, r) for k, r in zip(kinds, raws)], dtype="object")

    return run(kind, raw)


def parsed(documents: DataFrame, user: Column | None = None) -> DataFrame:
    """documents (path, text) with metadata, body, title and counts. Parser metadata overrides the user's.

    Front matter that does not parse stays in the body. Only texts that begin like one are sent to Python.
    """
    from ..functions import metadata as M

    f = documents.withColumn("_f", front_matter(F.col("text")))
    with_, without = f.where(F.col("_f.kind").isNotNull()), f.where(F.col("_f.kind").isNull())
    fields = with_.withColumn("_m", decoded("_f.kind", "_f.raw")).unionByName(without.withColumn("_m", F.lit(None).cast("map<string,string>")))
    body = F.when(F.col("_m").isNotNull(), F.col("_f.body")).otherwise(F.col("text"))
    out = fields.withColumn("body", body)
    own = F.create_map(
        *[
            x
            for k, v in (
                ("source_filename", T.file_name(F.col("path"))),
                ("document_type", F.lit("markdown")),
                ("line_count", T.line_count(F.col("body")).cast("string")),
                ("word_count", T.word_count(F.col("body")).cast("string")),
                ("char_count", F.length("body").cast("string")),
                ("heading_count", T.heading_count(F.col("body")).cast("string")),
                ("link_count", T.link_count(F.col("body")).cast("string")),
                ("code_block_count", T.code_block_count(F.col("body")).cast("string")),
            )
            for x in (F.lit(k), v)
        ]
    )
    heading = T.heading_title(F.col("body"))
    metadata = M.merged(user if user is not None else F.create_map().cast("map<string,string>"), F.col("_m"), own)
    title = F.coalesce(F.try_element_at(F.col("_m"), F.lit("title")), heading, T.inferred_title(F.col("body"), T.file_stem(F.col("path"))))
    return out.withColumn("metadata", metadata).withColumn("title", title).drop("_f", "_m")


def page_parts(text: Column, marker: str = MARKER) -> Column:
    """The text cut before each marker."""
    return F.split(text, f"(?={marker.replace('(', '(?:', 1) if '(' in marker else marker})")


def pages(documents: DataFrame, text: str = "text", key: str = "document_id", marker: str = MARKER) -> DataFrame:
    """(key, page_number, content, original_page_number, has_page_marker): pages by markers, which stay in their page.

    Text before the first marker is page 0, unless blank or front matter. Pages are sorted by number, stably, and numbered
    from 1. A text without markers is page 1. Pages are ranked within one document.
    """
    cut = documents.where(F.col(text).isNotNull()).select(key, F.posexplode(page_parts(F.col(text), marker)).alias("pos", "part"))
    begins = r"\A" + marker
    own = cut.select(
        key,
        "pos",
        F.when(F.col("part").rlike(begins), F.regexp_extract("part", begins, 1).cast("int")).alias("original"),
        F.col("part").rlike(begins).alias("has_page_marker"),
        "part",
    )
    w = Window.partitionBy(key)
    marked = own.withColumn("any_marker", F.max("has_page_marker").over(w))
    before = ~F.col("has_page_marker")
    lead = T.stripped(F.col("part"))
    kept = marked.where(~F.col("any_marker") | ~before | ((lead != "") & ~lead.startswith("---") & ~lead.startswith("+++")))
    numbered = kept.withColumn("n", F.when(~F.col("any_marker"), 1).when(before, 0).otherwise(F.col("original")))
    order = F.row_number().over(w.orderBy("n", "pos"))
    zero = F.max(F.when(F.col("any_marker") & before, 1).otherwise(0)).over(w)
    number = F.when(F.col("any_marker") & before, 0).otherwise(order - zero)
    return numbered.select(
        key,
        number.cast("int").alias("page_number"),
        F.when(F.col("any_marker"), lead).otherwise(F.col("part")).alias("content"),
        F.when(F.col("has_page_marker") & (F.col("original") != number), F.col("original")).alias("original_page_number"),
        "has_page_marker",
    )


#: What stands for a page that cannot be read, or whose transcription fails.
UNREADABLE = "# Page {n}\n\n*[Error: Could not process this page]*\n"
FAILED = "# Page {n}\n\n*[Error: Could not transcribe this page: {error}]*\n"
#: Fixed value: what stands between transcribed pages.
BETWEEN_PAGES = "\n\n---\n\n"


def transcribed(images: DataFrame, transcribe: Callable[[bytes, int], str], at_once: int = 5, key: str = "document_id") -> DataFrame:
    """(key, page_number, content) of page images (key, page_number, image) by a callable; at most ``at_once`` tasks call it. A page that fails is a note of its error."""
    kind = dict(images.dtypes)[key]

    def run(batches):
        for b in batches:
            out = []
            for n, image in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                try:
                    out.append(UNREADABLE.format(n=n) if image is None else transcribe(image, n))
                except Exception as e:  # a service may fail in any way
                    out.append(FAILED.format(n=n, error=e))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], [key, "page_number", "content"])

    rows = images.select(key, F.col("page_number").cast("int").alias("page_number"), "image").repartition(at_once, key, "page_number")
    return rows.mapInArrow(run, f"{key} {kind}, page_number int, content string")


def combined(page_rows: DataFrame, key: str = "document_id", separator: str = "\n\n") -> DataFrame:
    """(key, content): the pages of each document in order, joined by blank lines."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "content")))
    return page_rows.groupBy(key).agg(F.concat_ws(separator, F.transform(ordered, lambda p: p["content"])).alias("content"))


def summary_content(page_rows: DataFrame, most_pages: int = 10, key: str = "document_id") -> DataFrame:
    """(key, content): the first pages under headers of their numbers; blank pages are left out."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("page_number"))
    first = page_rows.withColumn("_r", rank).where((F.col("_r") <= most_pages) if most_pages > 0 else F.lit(True))
    shown = F.concat(F.lit("--- Page "), F.col("page_number"), F.lit(" ---\n"), F.col("content"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("content") != "", F.struct("page_number", shown.alias("s")))))
    return first.groupBy(key).agg(F.concat_ws("\n\n", F.transform(ordered, lambda p: p["s"])).alias("content"))


def element_markdown(kind: Column, text: Column) -> Column:
    """One element as Markdown: titles as headings as deep as they have words, tables between marks, list items with a dash."""
    t = T.stripped(text)
    level = F.least(T.word_count(t), F.lit(6))
    return F.when(t == "", None).when(kind.isin("Title", "Header"), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), t)).when(kind == "Table", F.concat(F.lit("[TABLE]\n"), t, F.lit("\n[/TABLE]"))).when(
        kind == "ListItem", F.concat(F.lit("- "), t)
    ).otherwise(t)


def elements_to_markdown(elements: DataFrame, key: str) -> DataFrame:
    """(key, markdown) of elements (key, position, kind, text), in order."""
    m = F.struct("position", element_markdown(F.col("kind"), F.col("text")).alias("m"))
    ordered = F.filter(F.array_sort(F.collect_list(m)), lambda x: x["m"].isNotNull())
    return elements.groupBy(key).agg(F.concat_ws("\n\n", F.transform(ordered, lambda x: x["m"])).alias("markdown"))


def element_statistics(elements: DataFrame, key: str) -> DataFrame:
    """(key, kind, elements, pages): counts of each kind, and on how many pages it stands."""
    return elements.groupBy(key, "kind").agg(F.count("*").alias("elements"), F.countDistinct("page_number").alias("pages"))
