"""Files as DataFrames: recursive scans, type routing, Markdown and pluggable PDF parsing."""

from __future__ import annotations

import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T

EXTENSIONS = (".pdf", ".md", ".markdown")
EXCLUDED = ("uploads", ".cache")


def is_supported(path: Column, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    return T.file_suffix(path).isin(*extensions)


def is_excluded(path: Column, root: str | None = None, excluded: tuple[str, ...] = EXCLUDED) -> Column:
    """Whether a part of the path below root is excluded; paths outside root are not."""
    relative = path
    outside = F.lit(False)
    if root is not None:
        prefix = root.rstrip("/") + "/"
        outside = ~path.startswith(prefix)
        relative = F.substring(path, F.lit(len(prefix) + 1), F.length(path))
    return ~outside & F.exists(F.split(relative, "/"), lambda p: p.isin(*excluded))


def route(path: Column) -> Column:
    suffix = T.file_suffix(path)
    return F.when(suffix == ".pdf", "pdf").when(suffix.isin(".md", ".markdown"), "markdown").otherwise("unsupported")


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, checksum, last_modified, file_size, content) of supported files below root; content is read only where it is used."""
    base = os.path.abspath(root) if "://" not in root else root
    out = _read(spark.read.option("recursiveFileLookup", "true"), root)
    return out.where(is_supported(F.col("path"), extensions) & ~is_excluded(F.col("path"), base))


def listed(files: DataFrame) -> DataFrame:
    """(path, last_modified, file_size) of scan() or given(): no file is opened for it."""
    return files.select("path", "last_modified", "file_size")


#: Files that are read by name, their names brought to the driver; more are picked out of a scan of everything.
BY_NAME = 10_000


def contents(spark: SparkSession, everything: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of everything, a scan() or given(), for the paths in wanted (path): up to BY_NAME files are opened alone."""
    paths = [r.path for r in wanted.select("path").distinct().limit(BY_NAME + 1).collect()]
    if len(paths) <= BY_NAME:
        return _read(spark.read, paths) if paths else everything.where("false")
    return everything.join(wanted.select("path").distinct(), "path", "left_semi").select(*everything.columns)


def _read(reader, paths) -> DataFrame:
    path = F.regexp_replace("path", "^file:(//)?", "")
    return reader.format("binaryFile").load(paths).select(path.alias("path"), ids.checksum(F.col("content")).alias("checksum"), F.col("modificationTime").cast("double").alias("last_modified"), F.col("length").alias("file_size"), "content")


def given(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """Like scan() for those of some files, named one by one, that are there; None if none is."""
    exists = lambda p: (at := spark._jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    there = [p for p in paths if exists(p)]
    return _read(spark.read, there) if there else None


def upload(spark: SparkSession, root: str, name: str, content: bytes, timestamp: int, token: str) -> str:
    """Stores a file under root/uploads by a name of its own; returns its path."""
    path = f"{root.rstrip('/')}/uploads/{upload_name(os.path.basename(name), timestamp, token)}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, False)
    out.write(bytearray(content))
    out.close()
    return path


def markdown_text(content: Column) -> Column:
    return F.decode(content, "UTF-8")


#: A parser from bytes to pages of Markdown.
PdfParser = Callable[[bytes], list[str]]


def missing_parser(content: bytes) -> list[str]:
    raise RuntimeError("no PDF parser is installed: pass one to pdf_pages()")


def chained(*parsers: PdfParser, meaningful: Callable[[str], bool] = lambda t: len(t.strip()) >= 10 and len(t.split()) >= 2) -> PdfParser:
    """Parsers tried in order for each page until one gives meaningful text; a page that none reads is a placeholder."""

    def parse(content: bytes) -> list[str]:
        results, errors = [], []
        for p in parsers:
            try:
                results.append(p(content))
            except Exception as e:  # a parser may fail in any way
                errors.append(e)
        if not results:
            raise errors[0] if errors else RuntimeError("no parser given")
        n = max(map(len, results))
        out = []
        for k in range(n):
            texts = [r[k] for r in results if k < len(r)]
            out.append(next((t for t in texts if meaningful(t)), f"[Page {k + 1}: no text]"))
        return out

    return parse


#: Fixed value: what stands for a page that no parser reads.
PLACEHOLDER = "no text]"


def with_markers(pages: DataFrame) -> DataFrame:
    """(path, text, error, placeholders) of pdf_pages(): pages in order under the marks of their numbers, and the numbers of pages that no parser read."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("page_number").isNotNull(), F.struct("page_number", "content"))))
    marked = F.transform(ordered, lambda p: F.concat(F.lit("--[PAGE: "), p["page_number"].cast("string"), F.lit("]--\n"), p["content"]))
    lost = F.transform(F.filter(ordered, lambda p: p["content"].startswith("[Page ") & p["content"].endswith(PLACEHOLDER)), lambda p: p["page_number"])
    return pages.groupBy("path").agg(F.concat_ws("\n", marked).alias("text"), F.max("error").alias("error"), lost.alias("placeholders"))


def pdf_pages(files: DataFrame, parser: PdfParser = missing_parser) -> DataFrame:
    """(path, page_number, content, error): pages from 1, or one row with the error of a file that cannot be parsed."""

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [(path, i + 1, t, None) for i, t in enumerate(parser(content))]
                except Exception as e:  # one bad file is one row, not a failed job
                    rows.append((path, None, None, str(e)))
            types = [pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["path", "page_number", "content", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, page_number int, content string, error string")


def upload_name(name: str, timestamp: int, token: str) -> str:
    """<stem>_<time>_<8 hex digits><suffix>."""
    stem, suffix = os.path.splitext(name)
    return f"{stem}_{timestamp}_{token[:8]}{suffix}"
