"""Token ids of whole texts, cut into pieces that fit a sequence.

Ids are those of the byte-level BPE in a ``tokenizers`` JSON file, special tokens
included, none added. They are computed by the byte-pair encoder of ``tiktoken`` over
the JSON's own vocabulary and merges, which gives the same ids in a quarter of the time;
the tests compare the two on whole tables. A vocabulary whose ids do not follow its merge
order, or that has another normaliser or pre-tokeniser, is encoded by ``tokenizers``.
"""

from __future__ import annotations

import functools
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

#: The pre-tokeniser pattern of the byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the id that ends a document.
END = 2


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if model.get("type") != "BPE" or not plain or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
        return None
    back, vocab = _byte_of(), model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    order = [vocab.get("".join(m)) for m in merges]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    singles = sorted(vocab[c] for c in back if c in vocab)
    if len(singles) != 256 or any(i is None for i in order) or order != sorted(order) or singles[-1] > order[0]:
        return None
    return {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in special}


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """A function text -> list of ids, made once a worker."""
    spec = json.load(open(path, encoding="utf-8"))
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in spec.get("added_tokens", []))
    ranks = _ranks(spec) if plain else None
    if ranks is None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)
    return lambda text: own.encode(text, allowed_special=allowed, disallowed_special=())


def width(path: str, end: int = END) -> str:
    """The narrowest little-endian type that holds every id of a vocabulary."""
    from tokenizers import Tokenizer

    largest = max([end, *Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()])
    return "<u2" if largest < 1 << 16 else "<u4"


def narrowed(ids: np.ndarray, dtype: str) -> bytes:
    """The ids in that type; an error if one does not fit."""
    if len(ids) and int(ids.max()) > np.iinfo(dtype).max:
        raise ValueError(f"id {int(ids.max())} does not fit {dtype}")
    return ids.astype(dtype).tobytes()


def pieces(docs: DataFrame, path: str, most: int, with_ids: bool = False, end: int = END, file_ids: str = "<u4") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth[, ids]) of documents (doc_id, text).

    A document is its ids and then ``end``; a null text is an empty one. Documents longer
    than ``most`` are cut into pieces of ``most``; only the first may be shorter. ``nth``
    counts the pieces of one length in one task, so that a written table holds a rank
    for each (task, length) without a shuffle.
    """

    def run(batches):
        encode, seen, task = encoder(path), {}, TaskContext.get().partitionId()
        for b in batches:
            out = [[] for _ in range(8)]
            size = 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), end], dtype="<u4")
                n = len(ids)
                first = (n - 1) % most + 1
                for piece, start in enumerate([0, *range(first, n, most)]):
                    part = ids[start : first if start == 0 else start + most]
                    nth = seen[len(part)] = seen.get(len(part), -1) + 1
                    row = (doc, piece, start, len(part), zlib.crc32(part.tobytes()), task, nth, narrowed(part, file_ids) if with_ids else None)
                    for column, value in zip(out, row):
                        column.append(value)
                    size += len(part)
                if size > 4_000_000:
                    yield batch(out)
                    out, size = [[] for _ in range(8)], 0
            if out[0]:
                yield batch(out)

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"]
    width = 8 if with_ids else 7

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)][:width], names[:width])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids binary" * with_ids
    return bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, schema)
