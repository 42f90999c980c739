"""Metadata maps: flattening, merging, and filters as predicates."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what a missing page is stored as.
NO_PAGE = -1


def merged(*maps: Column) -> Column:
    """One map; of equal keys the last map's value. Null maps count as empty."""
    out = None
    for m in maps:
        m = F.coalesce(m, F.create_map().cast("map<string,string>"))
        if out is None:
            out = m
            continue
        keys = F.map_keys(m)
        out = F.map_concat(F.map_filter(out, lambda k, v: ~F.array_contains(keys, k)), m)
    return out


def flattened(base: Column, document: Column, chunk: Column) -> Column:
    """base, then doc_<key> and chunk_<key>, without nulls."""
    doc = F.transform_keys(F.coalesce(document, F.create_map().cast("map<string,string>")), lambda k, v: F.concat(F.lit("doc_"), k))
    own = F.transform_keys(F.coalesce(chunk, F.create_map().cast("map<string,string>")), lambda k, v: F.concat(F.lit("chunk_"), k))
    return F.map_filter(merged(base, doc, own), lambda k, v: v.isNotNull())


def unflattened(flat: Column, prefix: str) -> Column:
    """The keys under a prefix, without it."""
    n = len(prefix) + 1
    return F.transform_keys(F.map_filter(flat, lambda k, v: k.startswith(prefix)), lambda k, v: F.substring(k, F.lit(n), F.length(k)))


def stored_page(page: Column) -> Column:
    return F.coalesce(page.cast("int"), F.lit(NO_PAGE))


def loaded_page(page: Column) -> Column:
    return F.nullif(page.try_cast("int"), F.lit(NO_PAGE))


NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _compare(value: Column, operator: str, operand, kind: str = "string") -> Column:
    if operator in ("$in", "$nin"):
        if not isinstance(operand, (list, tuple)):
            raise ValueError(f"{operator} needs a list")
        if operand and operator == "$in" and all(isinstance(x, str) for x in operand):
            return value.isin(list(operand))
        hit = F.lit(False)
        for x in operand:
            hit = hit | _compare(value, "$eq", x, kind)
        return hit if operator == "$in" else value.isNotNull() & ~hit
    if isinstance(operand, bool):
        left, right = F.lower(value.cast("string")), F.lit(str(operand).lower())
    elif isinstance(operand, (int, float)):
        left, right = (value, F.lit(operand)) if kind in NUMERIC else (value.try_cast("double"), F.lit(float(operand)))
    else:
        left, right = value.cast("string"), F.lit(operand)
    compared = {
        "$eq": lambda: left == right,
        "$ne": lambda: left != right,
        "$gt": lambda: left > right,
        "$gte": lambda: left >= right,
        "$lt": lambda: left < right,
        "$lte": lambda: left <= right,
    }
    if operator not in compared:
        raise ValueError(f"unknown operator {operator}")
    return compared[operator]()


def predicate(where: dict | str | None, columns: list[str] | dict[str, str], *maps: Column) -> Column:
    """A filter as a condition: scalar = equality, list = IN, dict = operators; $and and $or nest.

    A key is a column if there is one of the name (so that it reaches the scan), else it is looked up in the maps in
    order, also without a doc_ or chunk_ prefix. A missing key satisfies nothing, $ne and $nin included (the
    condition is then null, which a filter takes for false). Give the columns' types, so that numbers are compared without a cast.
    """
    kinds = columns if isinstance(columns, dict) else {}
    if isinstance(where, str):
        where = json.loads(where)
    if not where:
        return F.lit(True)

    def value(key: str) -> Column:
        if key in columns:
            return F.col(f"`{key}`")
        names = [key] + [key[len(p) :] for p in ("doc_", "chunk_") if key.startswith(p)]
        found = [F.try_element_at(m, F.lit(n)) for m in maps for n in names]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    out = F.lit(True)
    for key, wanted in where.items():
        if key in ("$and", "$or"):
            parts = [predicate(w, columns, *maps) for w in wanted]
            both = F.lit(key == "$and")
            for p in parts:
                both = both & p if key == "$and" else both | p
            out = out & both
        elif isinstance(wanted, dict):
            for operator, operand in wanted.items():
                out = out & _compare(value(key), operator, operand, kinds.get(key, "string"))
        else:
            out = out & _compare(value(key), "$in" if isinstance(wanted, (list, tuple)) else "$eq", wanted, kinds.get(key, "string"))
    return out
