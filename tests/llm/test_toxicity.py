import random
import zlib

import zstandard as zstd
from pyspark.sql import functions as F

from lexmill.llm import toxicity

from . import edge

SYLLABLES = "ba ce di fo gu ha ke li mo nu pa re si to vu".split()


def corpus(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(20, 200))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(r.randint(2, 6)):
                words.insert(r.randrange(len(words)), r.choice(["grukwort", "blystem", "zwinx" + r.choice(SYLLABLES)]))
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_held_out_accuracy(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").withColumn("quality", F.lit(None).cast("int"))
    model = toxicity.fit(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    held = [(scores[i] >= 0.5, bool(y)) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(0 <= s <= 1 for s in scores.values()) and len(held) > 200
    assert sum(a == b for a, b in held) / len(held) > 0.97


def test_labels_of_the_held_out_fold_do_not_train(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y
    fits = [toxicity.fit(docs, spark.createDataFrame([(i, f(i, y)) for i, _, y in rows], "doc_id long, toxic int")) for f in (lambda i, y: y, flip)]
    assert fits[0].contents == fits[1].contents and (fits[0].weights == fits[1].weights).all()


def test_distances_equal_plain_compression():
    rows = corpus(400)
    model = toxicity.Model([t for _, t, y in rows if y], [t for _, t, y in rows if not y])
    distance = toxicity.Distance(*model.contents)

    def size(content, window):
        p = zstd.ZstdCompressionParameters(format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, window_log=18, hash_log=16, chain_log=17, search_log=8, min_match=4, target_length=64, strategy=zstd.STRATEGY_LAZY2)
        dictionary = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        packed = zstd.ZstdCompressor(dict_data=dictionary, compression_params=p).compress(window)
        assert zstd.ZstdDecompressor(dict_data=dictionary, format=zstd.FORMAT_ZSTD1_MAGICLESS).decompress(packed, max_output_size=10_000) == window
        return len(packed)

    words = sorted(set(" ".join(t for _, t, _ in rows[:40]).split()) | {"grukwort", "zwinxba", "unseen", "é"})
    toxic, ordinary = model.contents
    for w in words[:300]:
        window = f" {w} ".encode() + toxicity.PAD
        assert distance({w}) == [size(ordinary, window) - size(toxic, window)]
    assert distance({"grukwort"})[0] > max(distance({w})[0] for w in ("base", "cedifo"))


def test_fit_is_bounded():
    long = "".join(random.Random(5).choice("abcdefgh") for _ in range(toxicity.LONGEST))
    assert max(map(len, toxicity.beginnings({long, "short"}))) <= toxicity.BEGINNING + 1 and len(toxicity.beginnings({long})) < 30
    rows = corpus(100)
    model = toxicity.Model([t for _, t, y in rows if y] + [long], [t for _, t, y in rows if not y] + [long[::-1]])
    assert all(len(c) <= toxicity.CONTENT for c in model.contents)


def test_rows_that_are_not_there_do_not_shrink_the_fit(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "ROWS", 20)
    rows = [(i, t, y) for i, t, y in corpus(400) if i % 3 == 0]  # two of three labelled rows are missing
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    given = []
    monkeypatch.setattr(toxicity, "Model", lambda toxic, ordinary: given.append((len(toxic), len(ordinary))))
    toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in corpus(400)], "doc_id long, toxic int"))
    assert given == [(20, 20)]


def test_small_table(spark, small):
    rows = toxicity.op8_toxicity(spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)


def test_odd_documents(spark):
    docs = edge.documents(spark)
    labels = spark.createDataFrame([(7, 1), (8, 0), (6, 0), (9, None), (None, 1), (4, 1), (3, 0), (7, 1)], "doc_id long, toxic int").withColumn("score", F.lit(1))
    for given in (labels, labels.where("false"), labels.where("toxic = 1")):
        model = toxicity.fit(docs, given)
        got = toxicity.scored(docs, model).collect()
        assert len(got) == len(edge.TEXTS) and all(0 <= r.score <= 1 for r in got)
        by = {t: {r.score for r in got if r.doc_id == i} for i, t in edge.TEXTS if i is not None}
        assert len(by[None] | by[""]) == 1
        kept = toxicity.accepted(docs, given)
        assert kept.columns == docs.columns
        assert sorted(map(str, kept.select("doc_id").collect())) == sorted(f"Row(doc_id={r.doc_id})" for r in got if r.score < 0.5)
    assert toxicity.scored(edge.empty(spark), toxicity.fit(edge.empty(spark), labels)).collect() == []
