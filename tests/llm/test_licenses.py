import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import licenses as L
from lexmill.llm.words import Vocabulary

from . import edge


def test_catalogue_finds_itself():
    index, v = L.Index(L.TEMPLATES), Vocabulary()
    for name, text in L.TEMPLATES.items():
        before, after = "Some words before it. ", " And some words after it."
        got = L.scan(index, v, before + text + after)
        assert [(g[0], g[3]) for g in got] == [(name, 1.0)], name
        assert (before + text + after)[got[0][4] : got[0][5]] == text


def test_edited_text_and_spans():
    words = L.TEMPLATES["MIT-text"].split()
    del words[40:44]
    words[80] = "something"
    words[10:10] = ["(really)", "now"]
    text = "x y z " * 50 + " ".join(words) + " q" * 90
    ((name, matched, total, coverage, a, b),) = L.scan(L.Index(L.TEMPLATES), Vocabulary(), text)
    assert name == "MIT-text" and matched == total - 5 and text[a:b] == " ".join(words)


def test_half_a_text_is_not_reported():
    words = L.TEMPLATES["MIT-text"].split()
    assert L.scan(L.Index(L.TEMPLATES), Vocabulary(), " ".join(words[: len(words) // 2])) == []


def test_each_copy_is_reported():
    line = L.TEMPLATES["GPL-3.0"]
    got = L.scan(L.Index(L.TEMPLATES), Vocabulary(), f"{line} and {line} or {line}")
    assert [g[0] for g in got] == ["GPL-3.0"] * 3


@pytest.mark.parametrize("name", ["MIT", "CC-BY-4.0", "Apache-2.0", "MIT-tag", "GPL-3.0", "Unlicense"])
@pytest.mark.parametrize("between", ["", "some words here. ", "a "])
def test_adjacent_copies(name, between):
    index, v = L.Index(L.TEMPLATES), Vocabulary()
    for n in (1, 2, 3, 5, 50, 500):
        one = f"{L.TEMPLATES[name]} {between}"
        got = L.scan(index, v, one * n)
        assert [(g[0], g[4], g[5]) for g in got] == [(name, k * len(one), k * len(one) + len(L.TEMPLATES[name])) for k in range(n)]


def test_many_reports_take_linear_time():
    index, v, texts = L.Index(L.TEMPLATES), Vocabulary(), list(L.TEMPLATES.values())
    lines = [texts[k % len(texts)] + f" line {k} of many." for k in range(400)]
    L.scan(index, v, " ".join(lines))
    times = []
    for n in (2, 16):
        start = time.process_time()
        got = L.scan(index, v, " ".join(lines * n))
        times.append(time.process_time() - start)
        assert len(got) >= 400 * n
    assert times[1] < 8 * times[0] * 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8)), max_size=20))
def test_spans_are_disjoint(given_):
    spans, kept = L.Spans(), []
    for a, n in given_:
        free = not any(a < y and x < a + n for x, y in kept)
        assert spans.add(a, a + n) == free
        kept += [(a, a + n)] * free


def brute_lcs(a, b, shift, band):
    best = {(0, 0): 0}
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            inside = abs(j - 1 - (i - 1) - shift) <= band
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + 1 if inside and a[i - 1] == b[j - 1] else 0)
    return table[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), max_size=14), st.integers(-3, 8), st.integers(0, 4))
def test_alignment_equals_brute_force(a, b, shift, band):
    import numpy as np

    matched, first, past = L.aligned(np.array(a), np.array(b), shift, band)
    assert matched == brute_lcs(a, b, shift, band)
    if matched:
        spans = [(y - x, x, y) for x in range(len(b)) for y in range(x + 1, len(b) + 1) if brute_lcs(a, b[x:y], shift - x, band) == matched]
        assert (past - first, first, past) == min(spans)


@pytest.mark.parametrize("n", [1, 2, 3, 9, 40])
def test_runs_of_enough_words_share_a_fingerprint(n):
    r = random.Random(n)
    import numpy as np

    for _ in range(50):
        h = np.array([r.getrandbits(60) for _ in range(n)], dtype=np.uint64)
        places = L.winnowed(h, n + L.RUN - 1)
        assert all(any(p in places for p in range(k, k + L.WINNOW)) for k in range(max(1, n - L.WINNOW + 1)))


def test_small_table_equals_text_search(spark, small):
    found = {(r.doc_id, r.license) for r in L.op4_license_scans(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    short = {k: v for k, v in L.TEMPLATES.items() if k in ("MIT", "GPL-3.0", "Apache-2.0", "CC-BY-NC-4.0")}
    assert found == {(d.doc_id, k) for d in docs for k, v in short.items() if v in d.text} and found


def test_odd_documents(spark):
    assert L.licenses(edge.documents(spark)).collect() == []
    own = {"x": "word5 of the long text word6 of the long text", "empty": "", "one": "zzz"}
    got = L.licenses(edge.documents(spark), own).collect()
    assert {r.doc_id for r in got} == {6} and {r.license for r in got} == {"x"}
    assert L.licenses(edge.empty(spark)).collect() == []
    assert L.licenses(edge.documents(spark), {}).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), min_size=1, max_size=30), st.integers(0, 4))
def test_no_alignment_beats_the_bound(a, b, band):
    import numpy as np

    few, L.FEW = L.FEW, 0
    most = L.reachable(np.array(a), np.array(b), np.arange(-12, 32), band)
    L.FEW = few
    assert most.tolist() == L.reachable(np.array(a), np.array(b), np.arange(-12, 32), band).tolist()
    for shift in range(-12, 32):
        want = sum(any(a[i] == b[j] for j in range(max(0, i + shift - band), min(len(b), i + shift + band + 1))) for i in range(len(a)))
        assert most[shift + 12] == want >= L.aligned(np.array(a), np.array(b), shift, band)[0]


def test_a_phrase_said_50_000_times_stops_nothing():
    index, v = L.Index(L.TEMPLATES), L.Vocabulary()
    for phrase in ("the above copyright notice ", "permission is hereby granted "):
        start = time.process_time()
        assert L.scan(index, v, phrase * 50_000) == []
        assert time.process_time() - start < 5
    late = "the above copyright notice " * 50_000 + L.TEMPLATES["MIT"]
    assert [r[0] for r in L.scan(index, v, late)] == ["MIT"]


def test_scan_equals_alignment_at_every_candidate(monkeypatch):
    """Leaving out candidates by the bound changes nothing, and no report has more than aligning at all shifts gives."""
    r = random.Random(11)
    templates = {"a": "permission is granted to use copy and change this work for any purpose", "b": "use copy and change this work", "c": "the work comes as it is"}
    index, bound = L.Index(templates), L.reachable
    words = sorted({w for t in templates.values() for w in t.split()}) + ["noise", "more", "words"]
    found = 0
    for _ in range(40):
        text = []
        for _ in range(r.randrange(1, 5)):
            text += [r.choice(words) for _ in range(r.randrange(0, 12))]
            chosen = r.choice(list(templates.values())).split()
            if r.random() < 0.5:
                chosen[r.randrange(len(chosen))] = "noise"
            text += chosen
        v = L.Vocabulary()
        got = L.scan(index, v, " ".join(text))
        monkeypatch.setattr(L, "reachable", lambda template, text, shifts, band: [len(template)] * len(shifts))
        assert L.scan(index, v, " ".join(text)) == got
        monkeypatch.setattr(L, "reachable", bound)
        hashes, _ = L.hashed(v, text)
        for name, matched, *_ in got:
            template = index.words[index.names.index(name)]
            assert matched <= max(L.aligned(template, hashes, shift)[0] for shift in range(-len(template), len(text) + 1))
            found += 1
    assert found > 60
