import re

from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import decontaminate, packing, registry, tokens, toxicity

from . import edge
from .test_decontaminate import brute
from .test_similar import brute_kept


def test_stages_by_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    model = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    rows = [r.asDict() for r in docs.collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    distance = toxicity.Distance(*model.contents)
    want = [{r["doc_id"]: r for r in rows if model.score(distance(toxicity.windows(r["text"]))) < 0.5}]
    kept = brute_kept([(i, r["text"]) for i, r in want[0].items()])
    want.append({i: r for i, r in want[0].items() if i in kept})
    leaks = {d for d, _ in brute([(i, r["text"]) for i, r in want[1].items()], bench)}
    want.append({i: r for i, r in want[1].items() if i not in leaks})
    for (name, stage), kept in zip(corpus_pipeline.STAGES, want):
        docs = stage(spark, docs, small).cache()
        assert docs.columns == columns, name
        assert {r.doc_id: r.asDict() for r in docs.collect()} == kept, name
    assert len(want[0]) >= len(want[1]) > len(want[2])
    out = corpus_pipeline.STAGES[3][1](spark, docs, small).cache()
    assert out.columns == columns and out.count() == len(want[2])
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert out.where(F.col("text").rlike(r"password=")).count() == sum(1 for r in want[2].values() if re.search("password=", r["text"]))
    last = corpus_pipeline.STAGES[4][1](spark, out, small)
    assert {r.doc_id for r in last.collect()} == set(want[2])
    whole = corpus_pipeline.run(spark, small)
    assert sorted(map(repr, whole.drop("sequence_id", "offset").collect())) == sorted(map(repr, last.drop("sequence_id", "offset").collect()))


def test_odd_documents(spark, small):
    docs = edge.documents(spark, [(i, t) for i, t in edge.TEXTS if i != 11]).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        n = out.count()
        assert 0 < n <= docs.count(), name
        assert stage(spark, docs.where("false"), small).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), small).count() == 0


def test_registry():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    assert decontaminate.WINDOW == 5 and decontaminate.SHARE == 0.8
    assert packing.PLANNERS and tokens.END == 2
