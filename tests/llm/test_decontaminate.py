import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexmill.llm import decontaminate as D
from lexmill.llm.words import UNITS

from . import edge

QUESTION = "On Monday the farmer Anna Miller sold 12 baskets of apples to Peter Brown for 3 dollars each and later Anna Miller bought 7 kg of flour; how many dollars did Anna Miller keep?"
CHANGED = "On Monday the farmer Clara Jones sold 15 baskets of apples to David Smith for 4 dollars each and later Clara Jones bought 9 kg of flour; how many dollars did Clara Jones keep?"
MIXED = "On Monday the farmer Clara Jones sold 15 baskets of apples to David Smith for 4 dollars each and later Erik Lang bought 9 kg of flour; how many dollars did Olga Kim keep?"
OTHER = "The quick brown animal went over a sleeping dog and then it came back to its home near the small river bank"


def canonical(text):
    """Of each word: as it stands, without punctuation and in lower case, its kind and whether it may be a name; from the operator's description."""
    out = []
    for word in (text or "").split():
        core = re.sub(r"^[\W_]+|[\W_]+$", "", word)
        low = core.lower()
        bare = word.strip("()[]{}\"'.,;:!?")
        unit = re.fullmatch(r"[-+]?[$€£]?\d[\d.,]*([^\W\d_]+)", core)
        if not core:
            kind = "none"
        elif low in UNITS:
            kind = "unit"
        elif not core.isalpha() and (re.fullmatch(r"[-+]?[$€£]?\d[\d.,:/]*%?", bare) or unit and unit[1].lower() in UNITS):
            kind = "number"
        else:
            kind = "word"
        title = bool(core) and core[0].isupper() and not any(c.isupper() for c in core[1:])
        out.append({"stands": word.strip(".,;:!?()[]{}\"'").lower(), "low": low, "kind": kind, "title": title, "ends": word.rstrip("\"')]}").endswith((".", "!", "?", ":"))})
    words = [w for w in out if w["kind"] != "none"]
    before = None
    for w in words:
        if w["kind"] == "unit" and not (before and before["kind"] == "number"):
            w["kind"] = "word"
        w["name"] = w["title"] and before is not None and not before["ends"] and w["kind"] == "word"
        before = w
    return out, words


def windows_of(text, lengths=None):
    """[(channel, window, place, fillings)]: lengths None for an item."""
    every, words = canonical(text)
    out = []
    for channel in (0, 1):
        shown = [("<number>" if w["kind"] == "number" else "<unit>" if w["kind"] == "unit" else "<name>" if channel and w["name"] else w["low"]) for w in words]
        free = [s[0] + s[-1] == "<>" for s in shown]
        slot = [s in ("<number>", "<name>") and f for s, f in zip(shown, free)]
        for n in lengths or [min(5, len(words))]:
            for k in range(len(words) - n + 1 if n else 0):
                if n - sum(free[k : k + n]) >= min(3, n):
                    out.append((channel, tuple(shown[k : k + n]), k, tuple(words[j]["stands"] for j in range(k, k + n) if slot[j])))
    if lengths or not out:
        stands = [w for w in every if w["stands"]]
        literal = [w["kind"] == "word" for w in stands]
        for n in lengths or [min(5, len(stands)) if words else 0]:
            for k in range(len(stands) - n + 1 if n else 0):
                if sum(literal[k : k + n]) < min(3, n):
                    out.append((2, tuple(w["stands"] for w in stands[k : k + n]), 0, ()))
    return out


def brute(docs, items, share=D.SHARE):
    """Pairs (doc_id, item_id), from the description alone."""
    found = set()
    of_items = [(i, windows_of(t)) for i, t in items]
    lengths = sorted({len(w) for _, own in of_items for _, w, _, _ in own}) or [5]
    for doc, text in docs:
        have = defaultdict(list)
        for channel, w, at, filled in windows_of(text, lengths):
            have[channel, w].append((at, filled))
        for item, own in of_items:
            for channel in (0, 1, 2):
                mine = {w for c, w, _, _ in own if c == channel}
                met = [(w, at - k, k, a, b) for c, w, k, a in own if c == channel for at, b in have.get((c, w), ())]
                fills = defaultdict(Counter)
                for _, shift, _, a, b in met:
                    for x, y in zip(a, b):
                        fills[shift, x][y] += 1
                most = {k: max(n, key=lambda y: (n[y], y == k[1], y)) for k, n in fills.items()}
                good = {w for w, shift, _, a, b in met if all(most[shift, x] == y for x, y in zip(a, b))}
                if mine and len(good) >= share * len(mine) - 1e-9:
                    found.add((doc, item))
    return found


def test_reparameterised_question(spark):
    filler = "And then some other words follow here which belong to nothing at all. "
    docs = [(1, filler + QUESTION + " " + filler), (2, filler + CHANGED), (3, MIXED), (4, OTHER), (5, filler * 20), (6, QUESTION.upper().replace(",", "")), (7, QUESTION[: len(QUESTION) // 2])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(100, QUESTION), (101, OTHER + ".")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.leaks(d, b).collect()}
    assert set(got) == {(1, 100), (2, 100), (4, 101), (6, 100)}
    assert got[1, 100].coverage == 1 and got[1, 100].changed == 0
    assert got[2, 100].changed > 3


def test_one_word_exchanged(spark):
    words = OTHER.split()
    words[10] = "cat"
    longer = " ".join([*words, "where all of them lived in peace for a long time until the winter came and took the leaves"])
    item = " ".join([*OTHER.split(), "where all of them lived in peace for a long time until the winter came and took the leaves"])
    d = spark.createDataFrame([(1, longer)], "doc_id long, text string")
    assert [r.item_id for r in D.leaks(d, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()] == [5]


@pytest.mark.parametrize("filtered", [True, False])
def test_small_table_equals_brute_force(spark, small, monkeypatch, filtered):
    if not filtered:
        monkeypatch.setattr(D, "FILTER", -1)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text")
    got = {(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()}
    assert got == brute([tuple(r) for r in docs.collect()], [tuple(r) for r in bench.collect()]) and got


def test_made_up_texts_equal_brute_force(spark):
    r = random.Random(11)
    words = "the a price of is goes to Anna Peter Clara 3 4 5 7kg 12 km hours and, so. it? * = buys sells ; apples $5 2:1".split()
    items = [(k, " ".join(r.choice(words) for _ in range(r.randint(1, 14)))) for k in range(60)]
    docs = []
    for k in range(150):
        parts = []
        for _ in range(r.randint(1, 3)):
            own = r.choice(items)[1].split()
            swap = {w: r.choice(words) for w in set(own) if w[0].isdigit() or w[0].isupper()} if r.random() < 0.6 else {}
            parts += [swap.get(w, w) if r.random() < 0.9 else r.choice(words) for w in own]
        docs.append((k, " ".join(parts)))
    got = {(x.doc_id, x.item_id) for x in D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items) and len(got) > 100


def test_boilerplate_makes_no_pairs(spark):
    same = "Read the following text with care and answer in one short word: "
    items = [(k, same + " ".join(f"{c}{k}q" for c in "abcdefghijklmnopqrstuvwxyz") + f" {k}") for k in range(200)]
    docs = [(k, f"so {same}" + " ".join(f"z{k}{c}" for c in "abcdefghijklmnopqrst")) for k in range(300)] + [(1000, "see " + items[7][1])]
    spark.sparkContext.setJobGroup("boilerplate", "")
    got = [(r.doc_id, r.item_id) for r in D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert got == [(1000, 7)]


def test_fewer_words_than_a_window(spark):
    d = spark.createDataFrame([(1, "so we say hello dear world today"), (2, "hello dear"), (3, "hello dear world")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "Hello, dear world"), (2, "hello - dear !"), (3, "12 13")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.leaks(d, b).collect()} == {(1, 1), (3, 1), (1, 2), (2, 2), (3, 2)}


def test_odd_documents(spark):
    docs, r = edge.documents(spark), random.Random(1)
    items = [(1, "a repeated row with several words in it"), (2, None), (3, ""), (None, "a text without an id but with words"), (4, " ".join(r.choice("abcdefgh") * 3 for _ in range(3000))), (1, "a repeated row with several words in it"), (5, "word5 of the long text word6 of the long text")]
    b = spark.createDataFrame(items, "item_id long, text string").withColumns({"hash": F.lit(1), "id": F.lit(2), "doc_id": F.lit(3)})
    got = {(x.doc_id, x.item_id) for x in D.leaks(docs, b).collect()}
    assert got == {(9, 1), (6, 5)}
    kept = D.clean(docs, b)
    assert kept.columns == docs.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(str(i) for i, _ in edge.TEXTS if i not in (6, 9))
    for x, y in ((edge.empty(spark), b), (docs, b.where("false")), (edge.empty(spark), b.where("false"))):
        assert D.leaks(x, y).collect() == []
    assert D.clean(docs, b.where("false")).count() == len(edge.TEXTS)
