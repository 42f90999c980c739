import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import stemming
from lexmill.operators import catalog, embedding, fusion, search, textindex, vectorsearch

CORPUS = [
    ("doc_bread", "/docs/bread_baking.pdf", "Baking Bread at Home", [
        "Flour and water left in a warm kitchen begin to ferment after two days.",
        "A wet dough wants folding every half hour instead of long kneading.",
        "Steam in the first ten minutes of baking gives the crust its shine."]),
    ("doc_rye", "/docs/rye_breads.pdf", "Rye Breads and Baking Times", [
        "Rye sourdough rises slowly and needs a hot stone to spring in the oven.",
        "Whole rye flour soaks up more water than wheat flour does.",
        "The crumb of dense rye loaves sets only a day after baking."]),
    ("doc_oven", "/docs/oven_guide.pdf", "Clay Oven Guide", [
        "A clay oven stores the heat of a long fire in its thick walls.",
        "Brushes, peels and thermometers are useful tools for oven baking.",
        "Ash is swept out before loaves go onto the hot floor."]),
]


@pytest.fixture(scope="module")
def collection(spark):
    rows = [(f"{d}_chunk_{i}", d, t, i, i // 2 + 1, {"kind": "even" if i % 2 == 0 else "odd"}) for d, _, _, ts in CORPUS for i, t in enumerate(ts)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, text string, chunk_index int, page_number int, metadata map<string,string>")
    chunks = chunks.withColumns({"embedding": embedding.hashed(F.col("text")), "document_metadata": F.create_map(F.lit("owner"), F.left("document_id", F.lit(6)))}).cache()
    docs = spark.createDataFrame([(d, p, t) for d, p, t, _ in CORPUS], "document_id string, path string, title string").withColumns({"added_at": F.current_timestamp(), "metadata": F.create_map(F.lit("owner"), F.left("document_id", F.lit(6)))})

    def embed(query):
        v = spark.createDataFrame([(query,)], "t string").select(embedding.hashed(F.col("t")).alias("v")).first().v
        return list(v) if v is not None else None

    return search.Collection(chunks, docs, textindex.TextIndex.build(chunks), embed)


QUERIES = ["baking", "rye OR clay", "baking NOT oven", "rye -loaves", '"hot stone"', '"stone hot"', "(rye OR clay) oven", "text:rye^3 OR clay", "rye document_id:doc_rye", "hot chunk_id:doc_oven_chunk_2", "the of", "nothing",
           "lo*s", "l?aves", "thermo* OR rye^2", '"hot floor" OR b*ng', "http://rye baking"]


def test_chunks_postings_and_written_index_agree(spark, collection, tmp_path):
    built = textindex.TextIndex.build(collection.chunks)
    built.write(f"{tmp_path}/index", 5)
    written = textindex.TextIndex.read(spark, f"{tmp_path}/index")
    postings = textindex.TextIndex(built.with_positions(), built.statistics)
    positive = 0
    for q in QUERIES:
        got = [[tuple(r) for r in textindex.search(index, q, 20).collect()] for index in (built, postings, written)]
        assert got[0] == got[1] == got[2], q
        positive += bool(got[0])
    assert positive == len(QUERIES) - 4


def test_query_language(collection):
    index = textindex.TextIndex.build(collection.chunks)
    found = lambda q: {r.chunk_id for r in textindex.search(index, q, None).collect()}
    assert found("rye document_id:doc_rye") == {f"doc_rye_chunk_{k}" for k in range(3)} and found("hot -chunk_id:doc_oven_chunk_2") == {"doc_rye_chunk_0"}
    assert found("fl*r") == {"doc_bread_chunk_0", "doc_rye_chunk_1", "doc_oven_chunk_2"} and found("fl?ur") == {"doc_bread_chunk_0", "doc_rye_chunk_1"}
    first = lambda q: textindex.search(index, q, 1).first().chunk_id
    assert first("steam^9 OR clay") == "doc_bread_chunk_2" and first("steam OR clay^9") == "doc_oven_chunk_0"
    assert found("flor~") == {"doc_bread_chunk_0", "doc_rye_chunk_1", "doc_oven_chunk_2"} and found("flours~ NOT floor") == found("flour") and found("[flour TO flour]") == found("flour") == found("{flot TO flov}")
    assert found("[zz TO]") == set() and found("[flour TO flour] -rye") == found("flour NOT rye")
    numbered = lambda q: {r.chunk_id for r in textindex.search(index, q, None, chunks=collection.chunks).collect()}
    assert numbered("rye chunk_index:[1 TO 2]") == {x for x in found("rye") if x[-1] in "12"} and numbered("rye chunk_index:1") == {x for x in found("rye") if x[-1] == "1"}
    for bad in ("page_number:3", "metadata:x", "[1 3]", "bread~3", "bre*d~1", "a~1.5", "rye OR chunk_index:3", "NOT page_number:[1 TO 2]", "rye -page_number:1", "page_number:[a TO b]", '"open', "(rye"):
        with pytest.raises(textindex.QueryError):
            textindex.search(index, bad)


def test_batch_equals_single(spark, collection):
    index = textindex.TextIndex.build(collection.chunks)
    asked = [(1, "hot oven"), (2, "rye"), (3, "baking nowhere"), (4, "flour water flour"), (5, "")]
    q = spark.createDataFrame(asked, "query_id long, text string")
    for every in (True, False):
        got = sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in textindex.search_batch(index, q, 3, every).collect())
        want = [(i, k + 1, r.chunk_id, r.score) for i, t in asked for k, r in enumerate(textindex.search(index, t if every else " OR ".join(t.split()), 3).collect())]
        assert got == want


#: Words and stems from the published description of the algorithm.
STEMS = "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc digitizer:digit radicalli:radic vileli:vile analogousli:analog vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic formative:form formalize:formal electriciti:electr electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt homologou:homolog communism:commun activate:activ angulariti:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll"


def test_stemmer(spark, collection):
    assert {w: stemming.stem(w) for w, _ in (x.split(":") for x in STEMS.split())} == dict(x.split(":") for x in STEMS.split())
    index = textindex.TextIndex.build(collection.chunks, "stemming")
    assert {r.chunk_id for r in textindex.search(index, "breads folded", None).collect()} == set()
    assert {r.chunk_id for r in textindex.search(index, "folded", None).collect()} == {"doc_bread_chunk_1"}
    assert {r.chunk_id for r in textindex.search(index, "loaf OR loaves", None).collect()} == {"doc_rye_chunk_2", "doc_oven_chunk_2"}


@pytest.mark.parametrize("kind", ["hybrid", "vector", "text"])
def test_kinds(collection, kind):
    rows = search.search(collection, "rye sourdough", 4, search_type=kind).collect()
    assert rows and rows[0].chunk_id in {f"doc_rye_chunk_{k}" for k in range(3)} and {r.search_type for r in rows} == {kind}
    assert [r.rank for r in rows] == sorted(r.rank for r in rows) and rows[0].title and rows[0].path


def test_hybrid_is_no_worse_at_the_top(collection):
    assert search.search(collection, "clay oven walls", 1).first().document_id == "doc_oven"


def test_filter_before_rank(collection):
    rows = search.search(collection, "baking", 9, {"owner": "doc_ov"}).collect()
    assert rows and {r.document_id for r in rows} == {"doc_oven"}
    assert {r.chunk_index % 2 for r in search.search(collection, "baking", 9, {"chunk_kind": "odd"}, "text").collect()} == {1}
    assert search.search(collection, "baking", 9, {"page_number": 2}, "vector").collect()


def test_validation(collection):
    for args in ({"query": " "}, {"query": "x", "limit": 0}, {"query": "x", "min_score": 2.0}, {"query": "x", "search_type": "magic"}):
        with pytest.raises(ValueError):
            search.search(collection, **args)


def test_rerank(collection):
    rows = search.search(collection, "useful baking tools", 2, rerank=embedding.overlap).collect()
    assert len(rows) == 2 and rows[0].chunk_id == "doc_oven_chunk_1" and rows[0].search_type == "reranked"


def arm(spark, *rows):
    return spark.createDataFrame([(c, i + 1, s) for i, (c, s) in enumerate(rows)], "chunk_id string, rank int, score double")


def test_fusion(spark):
    v = arm(spark, ("c0", 0.9), ("c1", 0.8), ("c2", 0.7), ("v", 0.85))
    t = arm(spark, ("c0", 10.0), ("c1", 9.0), ("c2", 8.0), ("t", 8.5))
    rows = fusion.reciprocal_rank_fusion(v, t, 10, 0.5, 0.5).collect()
    assert [r.chunk_id for r in rows] == ["c0", "c1", "c2", "t", "v"] and rows[0].score == round(1 / 61, 6) and rows[3].vector_score is None
    assert fusion.reciprocal_rank_fusion(arm(spark, ("a", 1.0)), arm(spark, ("b", 1.0)), 5, 0.8, 0.2).first().chunk_id == "a"
    with pytest.raises(ValueError):
        fusion.reciprocal_rank_fusion(v, t, 5, 0.5, 0.6)
    assert fusion.expanded_limit(10) == 20 and fusion.expanded_limit(40) == 30


def test_scopes(collection):
    collection.settings = search.Settings(scope_threshold=2, scope_documents=1)
    scopes = search.Scopes(10)
    rows = search.scoped_search(collection, "rye loaves", "s", scopes, 100.0, 9).collect()
    assert {r.document_id for r in rows} == {"doc_rye"}
    again = search.scoped_search(collection, "clay", "s", scopes, 105.0, 9).collect()
    assert {r.document_id for r in again} <= {"doc_rye"} and scopes.get("s", 111.0) is None
    collection.settings = search.Settings()


def test_pages(spark):
    rows = spark.range(12).orderBy("id")
    sizes, token = [], None
    for _ in range(3):
        part, token = search.page(rows, 5, token)
        sizes.append((part.count(), token))
    assert sizes == [(5, "5"), (5, "10"), (2, None)]


def test_similar_and_suggestions(collection):
    rows = search.similar_documents(collection, "doc_bread", 3).collect()
    assert "doc_bread" not in {r.document_id for r in rows}
    with pytest.raises(KeyError):
        search.similar_documents(collection, "doc_none")
    got = [r.suggestion for r in search.suggestions(collection.documents, "bak").orderBy("rank").collect()]
    assert got[0] == "Baking" and got[1] == "bak overview" and len(got) == 6


def test_vector_search(spark, monkeypatch):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None), ("d", [1.0]), ("e", [1.0, 0.0])], "chunk_id string, embedding array<float>")
    assert [(r.chunk_id, r.score) for r in vectorsearch.search(v, [1.0, 0.0], 3).collect()] == [("a", 1.0), ("e", 1.0), ("b", 0.0)]
    assert vectorsearch.search(v, [1.0, 0.0], 3, min_score=0.5).count() == 2
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, embedding array<float>")
    got = sorted(tuple(r) for r in vectorsearch.search_batch(v, q, 2).collect())
    assert got == [(1, 1, "a", 1.0), (1, 2, "e", 1.0), (2, 1, "b", 1.0), (2, 2, "a", 0.0)]
    assert vectorsearch.search_batch(v, q.where("false"), 2).collect() == []
    r = np.random.default_rng(2)
    rows = [(int(i), r.normal(size=3 if i % 7 else 2).tolist()) for i in range(200)]
    many = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    asked = many.where("chunk_id % 3 = 0").withColumnRenamed("chunk_id", "query_id")
    want = sorted(tuple(x) for x in vectorsearch.search_batch(many, asked, 4).collect())
    monkeypatch.setattr(vectorsearch, "BLOCK", 10)
    monkeypatch.setattr(vectorsearch, "STRIPE", 60)
    assert sorted(tuple(x) for x in vectorsearch.search_batch(many, asked, 4).collect()) == want and len(want) == 67 * 4


def test_embedding(spark):
    calls = []

    def embedder(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [[float(len(t))] for t in texts]

    chunks = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "bad"), (4, "known")], "chunk_id int, text string")
    cache = spark.createDataFrame([("known", [9.0])], "t string, embedding array<float>").select(F.md5(F.col("t").cast("binary")).alias("text_hash"), "embedding")
    got = {r.chunk_id: r.embedding for r in embedding.embedded(chunks, embedder, 1, cache).collect()}
    assert got == {1: [2.0], 2: [2.0], 3: None, 4: [9.0]}
    fails = iter([True, True, False])

    def flaky(texts):
        if next(fails):
            raise RuntimeError
        return [[1.0]]

    assert embedding.retrying(flaky, sleep=calls.append)(["x"]) == [[1.0]] and calls == [1.0, 2.0]
    small = embedding.halving(lambda t: (_ for _ in ()).throw(MemoryError) if len(t) > 1 else [[0.0]])
    assert small(["a", "b", "c"]) == [[0.0]] * 3
    a = chunks.select("chunk_id", embedding.hashed(F.col("text")).alias("v")).collect()
    b = {r.chunk_id: r.embedding for r in embedding.with_hashed(chunks).collect()}
    assert {r.chunk_id: r.v for r in a} == b and embedding.with_hashed(spark.createDataFrame([(1, ""), (2, None)], "i int, text string")).where("embedding is null").count() == 2


def test_catalog(collection):
    docs, chunks = collection.documents, collection.chunks
    assert catalog.contents(chunks).where("document_id = 'doc_bread'").first().content.count("\n\n") == 2
    rows = catalog.chunks_at(chunks, "doc_bread", "2,0,9,0").collect()
    assert [(r.chunk_index, r.missing) for r in rows] == [(0, False), (2, False), (9, True)]
    with pytest.raises(ValueError):
        catalog.chunks_at(chunks, "doc_bread", "1,x")
    assert catalog.resolved(docs, "docs/oven_guide.pdf", "/").count() == 1 and catalog.resolved(docs, "doc_bread").count() == 1
    page, info = catalog.listed(docs, 2, 2)
    assert page.count() == 1 and info == {"total": 3, "total_pages": 2, "has_next": False, "has_previous": True}
    assert catalog.statistics(docs.where("false"), chunks.where("false")).first().chunks_per_document == 0
    assert catalog.matching(docs, "CLAY").count() == 1
