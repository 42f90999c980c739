"""Deterministic identifiers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def document_id(path: Column, checksum: Column) -> Column:
    """doc_ and 16 hex digits of the SHA-256 of path|checksum."""
    return F.concat(F.lit("doc_"), F.left(F.sha2(F.concat(path, F.lit("|"), checksum), 256), F.lit(16)))


def chunk_id(document: Column, index: Column, text: Column, page: Column) -> Column:
    """chunk_ and 16 hex digits of the SHA-256 of document|index|text|page, a null page written None."""
    parts = [F.coalesce(document, F.lit("")), index.cast("string"), text, F.coalesce(page.cast("string"), F.lit("None"))]
    return F.concat(F.lit("chunk_"), F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16)))


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def path_key(path: Column) -> Column:
    """The 16 hex digits that name a path's cache entries."""
    return F.left(F.sha2(path, 256), F.lit(16))
