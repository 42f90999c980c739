import bisect
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import matrices, packing, tokens

from . import edge


def used(plan):
    return Counter({k: n for k, n in sum((Counter({x: layout.count(x) * times for x in set(layout)}) for layout, times in plan), Counter()).items()})


@settings(max_examples=150, deadline=None)
@given(st.integers(3, 40), st.data())
def test_plans_hold_every_piece(capacity, data):
    items = data.draw(st.lists(st.integers(1, capacity), max_size=40))
    for planner in packing.PLANNERS.values():
        plan = planner(dict(Counter(items)), capacity)
        assert used(plan) == Counter(items)
        assert all(sum(layout) <= capacity and times > 0 for layout, times in plan)


@settings(max_examples=100, deadline=None)
@given(st.integers(3, 25), st.data())
def test_first_bin_is_the_fullest(capacity, data):
    items = data.draw(st.lists(st.integers(1, capacity), min_size=1, max_size=9))
    rest = sorted(items)[:-1]
    sums = {sum(c) for k in range(len(rest) + 1) for c in combinations(rest, k)}
    want = max(items) + max(s for s in sums if s <= capacity - max(items))
    chosen = packing.fullest(dict(Counter(items)), capacity)
    assert sum(chosen) == want and not Counter(chosen) - Counter(items)


def one_by_one(items, capacity, slack):
    """Relaxed minimum bin slack by all subsets: bins as sorted tuples."""
    items, bins = sorted(items, reverse=True), []
    while items:
        seed, rest = items[0], items[1:]
        fits = {c for k in range(len(rest) + 1) for c in combinations(rest, k) if sum(c) <= capacity - seed}
        least = min(max(map(sum, fits)), capacity - seed - slack)
        best = max(c for c in fits if sum(c) >= least)  # of falling lengths: the longest pieces first
        bins.append((seed, *best))
        items = list((Counter(items) - Counter(bins[-1])).elements())
        items.sort(reverse=True)
    return sorted(bins)


@settings(max_examples=80, deadline=None)
@given(st.integers(3, 25), st.data())
def test_plan_is_that_of_minimum_bin_slack(capacity, data):
    items = data.draw(st.lists(st.integers(1, capacity), min_size=1, max_size=9))
    slacks = [0, *(1 << k for k in range(capacity.bit_length()))]
    want = [one_by_one(items, capacity, s) for s in slacks]
    for s, bins in zip(slacks, want):
        assert sorted(layout for layout, times in packing.taken(dict(Counter(items)), capacity, s) for _ in range(times)) == bins
    plan = sorted(layout for layout, times in packing.minimum_bin_slack(dict(Counter(items)), capacity) for _ in range(times))
    assert plan in want and len(plan) == min(map(len, want))


@settings(max_examples=200, deadline=None)
@given(st.integers(3, 60), st.data())
def test_best_fit_decreasing_equals_one_by_one(capacity, data):
    items = data.draw(st.lists(st.integers(1, capacity), max_size=60))
    rooms: list[int] = []
    for x in sorted(items, reverse=True):
        at = bisect.bisect_left(rooms, x)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bisect.insort(rooms, room - x)
    plan = packing.best_fit_decreasing(dict(Counter(items)), capacity)
    assert sorted(capacity - sum(layout) for layout, times in plan for _ in range(times)) == rooms


def test_overlong_piece():
    for planner in packing.PLANNERS.values():
        with pytest.raises(ValueError):
            planner({11: 1}, 10)


@pytest.fixture(scope="module")
def reference_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_those_of_the_tokenizer(text):
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path()
    global _TOKENIZER
    try:
        t = _TOKENIZER
    except NameError:
        t = _TOKENIZER = Tokenizer.from_file(path)
    text = text.encode("utf-8", "ignore").decode()
    assert tokens.encoder(path)(text) == t.encode(text, add_special_tokens=False).ids


def check_packing(rows, texts, ids_of, capacity):
    """texts: list of (doc_id, text). Pieces give every document's ids, sequences are gapless."""
    want = Counter()
    for doc, text in texts:
        ids = np.array([*ids_of(text), 2], dtype="<u4")
        n, first = len(ids), (len(ids) - 1) % capacity + 1
        for piece, start in enumerate([0, *range(first, n, capacity)]):
            end = first if piece == 0 else start + capacity
            want[doc, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(n for p in by.values() for _, n in p)
    return len(by), -(-total // capacity)


def test_pack_small_table(spark, small, reference_ids):
    d = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    sequences, least = check_packing(packing.op7_best_fit_packing(spark, small).collect(), [(r.doc_id, r.text) for r in d], reference_ids, 1024)
    assert sequences <= least + 1


def test_odd_documents(spark, reference_ids):
    texts = [(i, t) for i, t in edge.TEXTS if i != 11] + [(11, "x" * 20_000)]
    check_packing(packing.pack(edge.documents(spark, texts), capacity=64).collect(), texts, reference_ids, 64)
    assert packing.pack(edge.empty(spark)).collect() == []


def test_matrices_are_lossless(spark, small, reference_ids):
    rows = matrices.op3_token_id_output(spark, small).collect()
    got = defaultdict(dict)
    for r in rows:
        m = np.frombuffer(r.input_ids, "<u2")
        assert len(m) == 2048 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and not m[r.n_tokens :].any()
        assert r.position_resets == r.cu_seqlens[:-1]
        for k, (doc, piece) in enumerate(zip(r.doc_ids, r.pieces)):
            got[doc][piece] = m[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        assert [i for _, p in sorted(got[r.doc_id].items()) for i in p] == [*reference_ids(r.text), 2]


def test_ids_that_do_not_fit():
    wide = np.array([1, 70_000], dtype="<u4")
    assert tokens.narrowed(wide, "<u4") == wide.tobytes() and tokens.width(tokens.vocabulary_path()) == "<u2"
    with pytest.raises(ValueError):
        tokens.narrowed(wide, "<u2")


def test_wide_vocabulary(spark, tmp_path):
    import json

    words = {f"w{k}": k for k in range(70_000)}
    model = {"type": "WordLevel", "vocab": {**words, "[UNK]": 70_000}, "unk_token": "[UNK]"}
    path = tmp_path / "wide.json"
    path.write_text(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Whitespace"}, "post_processor": None, "decoder": None, "model": model}))
    docs = spark.createDataFrame([(1, "w5 w69999 none"), (2, "w65536")], "doc_id long, text string")
    rows = matrices.packed(docs, str(path), capacity=8).collect()
    got = {tuple(np.frombuffer(r.input_ids, "<u4")[: r.n_tokens].tolist()) for r in rows}
    assert got in ({(5, 69_999, 70_000, 2, 65_536, 2)}, {(65_536, 2, 5, 69_999, 70_000, 2)})


def test_written_matrices(spark, tmp_path):
    rows = matrices.packed(edge.documents(spark), capacity=128)
    manifest = matrices.write_matrices(rows, f"file://{tmp_path}/m").collect()
    want = {(r.n_tokens, bytes(r.input_ids)) for r in rows.collect()}
    got = set()
    for m in manifest:
        ids = np.fromfile(tmp_path / "m" / m.file, "<u2").reshape(-1, 128)
        got.add((m.n_tokens, ids[m.row].tobytes()))
    assert got == want and len(manifest) == len({(m.file, m.row) for m in manifest})
    assert matrices.packed(edge.empty(spark)).collect() == []
