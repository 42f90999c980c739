import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lexmill.llm import language
from lexmill.llm.toxicity import fold

from . import edge


def brute_model(texts, n=language.ORDER):
    """log p(character | the n - 1 before it), by the textbook: dictionaries of strings, no pruning."""
    counts = {n: Counter()}
    for t in texts:
        for w in language.words(t):
            s = " " * (n - 1) + w + " "
            counts[n].update(s[k : k + n] for k in range(len(w) + 1))
    for k in range(n - 1, 0, -1):
        before = defaultdict(set)
        for g in counts[n]:
            before[g[n - k :]].add(g[n - k - 1])
        counts[k] = Counter({g: len(b) for g, b in before.items()})
    sums = {k: Counter() for k in counts}
    kinds = {k: Counter() for k in counts}
    for k, c in counts.items():
        for g, x in c.items():
            sums[k][g[:-1]] += x
            kinds[k][g[:-1]] += 1
    discount = {}
    for k, c in counts.items():
        n1, n2 = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
        discount[k] = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.1

    def p(run):
        k = len(run)
        if k == 0:
            return 1 / language.ALPHABET
        h = run[:-1]
        if not sums[k][h]:
            return p(run[1:])
        return max(counts[k][run] - discount[k], 0) / sums[k][h] + discount[k] * kinds[k][h] / sums[k][h] * p(run[1:])

    return p


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def invented(r, letters, n):
    return " ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 9))) for _ in range(n))


def test_probabilities_equal_the_textbook(spark):
    r = random.Random(5)
    rows = [(i, invented(r, "aabbcdé", 12) + " aa Ab!", "x") for i in range(40)]
    docs = frame(spark, rows)
    left_out = {r.doc_id for r in docs.where((fold() == 0) | language.calibrating(F.col("doc_id"))).collect()}
    p = brute_model([t for i, t, _ in rows if i not in left_out])
    model = language.fit(docs)
    seen = ["ab", "éd", "zq", "a", "aaaaaaaabbbbbbbb", "日本"]
    sums = model.word_sums(seen)
    n = language.ORDER
    for w, got in zip(seen, sums[:, 0]):
        s = " " * (n - 1) + w + " "
        assert math.isclose(got, -sum(math.log(p(s[k : k + n])) for k in range(len(w) + 1)), rel_tol=1e-4), w
    for context in ("    ", "  ab", "aabb", "zzzz"):  # all that may follow sums to 1
        every = sorted({c for _, t, _ in rows for c in t.lower() if c.isalpha()} | {" "})
        runs = np.array([[*language.characters(context), *language.characters(c)] for c in every])
        rest = (language.ALPHABET - len(every)) * np.exp(float(model.models[0].log_probabilities(np.array([[*language.characters(context), 0x4E00]]))[0]))
        assert math.isclose(np.exp(model.models[0].log_probabilities(runs).astype(float)).sum() + rest, 1.0, rel_tol=1e-4)


def test_kept_runs_are_bounded_and_probabilities_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST", 200)
    r = random.Random(6)
    docs = frame(spark, [(i, invented(r, "abcdefghij", 30), "xy"[i % 2]) for i in range(60)])
    model = language.fit(docs)
    assert 0 < sum(len(x.keys) for m in model.models for x in m.runs) <= 200
    m = model.models[0]
    runs = np.array([[*language.characters("  ab"), c] for c in range(language.ALPHABET)], dtype=np.uint32)
    assert math.isclose(np.exp(m.log_probabilities(runs).astype(float)).sum(), 1.0, rel_tol=1e-3)


def test_held_out_accuracy_and_rejection(spark):
    r = random.Random(7)
    kinds = {"p": "aaeeoinst", "q": "eeiourlmd", "r": "öäüsstthh", "s": "ababcdxyz"}
    rows = [(i, invented(r, kinds["pqrs"[i % 4]], r.randrange(5, 40)), "pqrs"[i % 4]) for i in range(1600)]
    rows += [(10_000 + i, invented(r, "wkjvfgqp", 30), None) for i in range(50)]  # of no language that is learned
    docs = frame(spark, rows)
    out = {x.doc_id: x for x in language.identified(docs, language.fit(docs)).collect()}
    held = [i for i, in docs.where("lang is not null").where(fold() == 0).select("doc_id").collect()]
    assert len(held) > 200 and sum(out[i].lang_pred == rows[i][2] for i in held) / len(held) > 0.98
    assert sum(out[i].accepted for i in held) / len(held) > 0.9
    assert not any(out[i].accepted for i in out if i >= 10_000)
    assert all(0 <= x.score <= 1 for x in out.values())
    rejected = language.identified(docs.where("doc_id >= 10000"), language.fit(docs), reject=True)
    assert {x.lang_pred for x in rejected.collect()} == {"und"}


def test_real_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = language.op13_language_id(spark, small).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert out and sum(x.lang == x.lang_pred for x in out) / len(out) > 0.95


def test_odd_documents(spark):
    docs = edge.documents(spark, [(i, t) for i, t in edge.TEXTS] + [(20, "²½ 123 _"), (21, "İSTANBUL ǅ"), (22, "́")]).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").when(F.col("doc_id") == 6, "de"))
    out = language.identified(docs, language.fit(docs))
    assert out.columns == ["doc_id", "lang_pred", "score", "accepted", "entropy"]
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        no_letter = r.doc_id in (1, 2, 3, 20, 22) or (r.doc_id is None and r.lang_pred == "und")
        assert (r.lang_pred == "und") == no_letter and 0 <= r.score <= 1, r
    assert language.identified(edge.empty(spark), language.fit(edge.empty(spark))).count() == 0
    nothing = language.identified(docs, language.fit(docs.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and {r.score for r in nothing} == {0.0}


def test_a_long_text_is_read_whole(spark):
    r = random.Random(9)
    rows = [(i, invented(r, "abc" if i % 2 else "xyz", 30), "ab"[i % 2]) for i in range(200)]
    late = " ".join(["abc cab"] * 10) + " " + invented(r, "xyz", 60_000)
    out = language.identified(frame(spark, [(1, late, None)]), language.fit(frame(spark, rows))).first()
    assert out.lang_pred == "a"
