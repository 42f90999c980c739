"""Packed id matrices: best-fit-decreasing rows of token ids with their segment bounds.

Overlong documents are split losslessly; each row of the matrix is one sequence, padded at
its end. ``cu_seqlens`` holds the cumulative lengths of its segments from 0 to the number
of tokens, and position ids restart at 0 at each of its entries but the last.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import bounded, filesystem, saved, table
from .packing import placed

SCHEMA = "sequence_id long, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, position_resets array<int>, input_ids binary"


def packed(docs: DataFrame, path: str | None = None, capacity: int = 2048, pad: int = 0, dtype: str | None = None) -> DataFrame:
    """One row per sequence of documents (doc_id, text): its segments in order and its padded ids, little-endian.

    A null or empty text is one end token; null ids (null in doc_ids) and repeated rows are
    packed like any other; other columns are ignored; an empty table gives an empty table.
    A sequence holds at most ``capacity`` segments, which bounds every group gathered here. Ids are of
    ``dtype``, or else of the narrowest type that holds all of the vocabulary; one that does not fit is an error.
    """
    path = path or tokens.vocabulary_path()
    dtype = dtype or tokens.width(path)
    cut = saved(tokens.pieces(docs, path, capacity, with_ids=True, file_ids=dtype), "pieces")
    placed_ = placed(cut.drop("start", "ids_crc32"), capacity, "best_fit_decreasing")
    rows = placed_.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids"))).alias("s"))
    end = F.element_at("s", -1)
    n = (end["offset"] + end["length"]).cast("int")
    zeros = tokens.narrowed(np.full(capacity, pad, dtype=np.int64), dtype)
    width = np.dtype(dtype).itemsize
    starts = F.transform("s", lambda x: x["offset"].cast("int"))
    ids = F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select(
        "sequence_id",
        n.alias("n_tokens"),
        F.transform("s", lambda x: x["doc_id"]).alias("doc_ids"),
        F.transform("s", lambda x: x["piece"]).alias("pieces"),
        F.concat(starts, F.array(n)).alias("cu_seqlens"),
        starts.alias("position_resets"),
        F.concat(ids, F.substring(F.lit(zeros), F.lit(1), (F.lit(capacity) - n) * width)).alias("input_ids"),
    )


def write_matrices(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows of packed() as raw matrices, one file a task, in a shared folder; returns the written manifest.

    (file, sequence_id, row, n_tokens, cu_seqlens): only files named there are whole, so a
    task that ran twice leaves no doubt. Read a file with numpy.fromfile(...).reshape(-1, capacity).
    """

    def run(batches):
        fs, at = filesystem(folder)
        fs.create_dir(at, recursive=True)
        name, out, row = f"{uuid.uuid4().hex}.bin", None, 0
        for b in batches:
            out = out or fs.open_output_stream(f"{at}/{name}")
            for x in b.column(3).to_pylist():
                out.write(x)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), b.column(0), pa.array(range(row, row + n), pa.int64()), b.column(1), b.column(2)], ["file", "sequence_id", "row", "n_tokens", "cu_seqlens"])
            row += n
        if out:
            out.close()

    return saved(
        bounded(rows.select("sequence_id", "n_tokens", "cu_seqlens", "input_ids")).mapInArrow(run, "file string, sequence_id long, row long, n_tokens int, cu_seqlens array<int>"), "manifest"
    )


def op3_token_id_output(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))
