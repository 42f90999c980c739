import pytest
from pyspark.sql import functions as F

from lexmill.operators import chunking, markdown

YAML = "---\ntitle: The Title\nauthor: Me\ndate: 2024-01-01\ntags: [a, b]\n---\n# Heading\n\ntext [l](http://x)\n\n## Two\n\n```py\nx\n```\n"


def parsed(spark, text):
    return markdown.parsed(spark.createDataFrame([("/kb/some file.md", text)], "path string, text string")).first()


def test_yaml(spark):
    r = parsed(spark, YAML)
    assert r.title == "The Title" and r.metadata["author"] == "Me" and r.metadata["date"] == "2024-01-01" and r.metadata["tags"] == '["a", "b"]'
    assert r.body.startswith("# Heading") and (r.metadata["heading_count"], r.metadata["link_count"], r.metadata["code_block_count"]) == ("2", "1", "1")


def test_toml_and_neither(spark):
    r = parsed(spark, "+++\ntitle = 'T'\nn = 3\n+++\nbody\n")
    assert r.title == "T" and r.metadata["n"] == "3" and r.body == "body\n"
    bad = parsed(spark, "---\n: : [\n---\nbody here\n")
    assert bad.body.startswith("---") and bad.title == "some file"
    assert parsed(spark, "# My Document Title\n\n## Sub\n").title == "My Document Title"
    assert parsed(spark, "").metadata["word_count"] == "0"


def test_pages(spark):
    text = "lead\n--[PAGE: 9]--\nnine\n--[PAGE: 4]--\nfour"
    rows = markdown.pages(spark.createDataFrame([("d", text), ("e", "no marks"), ("f", "--[PAGE: 3]--only"), ("g", None)], "document_id string, text string")).orderBy("document_id", "page_number").collect()
    assert [(r.document_id, r.page_number, r.content, r.original_page_number) for r in rows] == [
        ("d", 0, "lead", None), ("d", 1, "--[PAGE: 4]--\nfour", 4), ("d", 2, "--[PAGE: 9]--\nnine", 9), ("e", 1, "no marks", None), ("f", 1, "--[PAGE: 3]--only", 3),
    ]


def pages(spark, *contents):
    return spark.createDataFrame([("d", i + 1, c) for i, c in enumerate(contents)], "document_id string, page_number int, content string")


def test_page_chunks(spark):
    rows = chunking.page_chunks(pages(spark, "Page 1 content", "Page 2 content", "Page 3 content"), 5).orderBy("chunk_index").collect()
    assert [r.page_number for r in rows] == [1, 2, 3] and rows[0].total_chunks == 3
    merged = chunking.page_chunks(pages(spark, "Small", "Also small", "x" * 72), 50).orderBy("chunk_index").collect()
    assert [r.page_numbers for r in merged] == [[1, 2], [3]] and merged[0].merged and merged[0].page_range == "1-2" and merged[0].text == "Small\n\nAlso small"
    assert chunking.page_chunks(pages(spark, "Small", "Also small"), 50, merge=False).count() == 2
    split = chunking.page_chunks(pages(spark, "This is a very long page. " * 10), 10, 50).collect()
    assert len(split) > 1 and all(len(r.text) <= 50 for r in split) and {r.split_total for r in split} == {len(split)}
    assert [r.text[0] for r in chunking.page_chunks(pages(spark, "A" * 50, "B" * 120, "C" * 200, "D" * 30), 100, global_least=150).collect()] == ["C"]
    assert chunking.page_chunks(pages(spark, "x").where("false")).collect() == []


def test_oversized_paragraph_appears_once():
    text = "first part\n\n" + "long sentence here. " * 20 + "\n\nlast part"
    parts = chunking.split_oversized(text, 60)
    assert all(len(p) <= 60 for p in parts) and "".join(parts).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")
    assert all(len(p) <= 10 for p in chunking.split_oversized("y" * 95, 10))


def test_recursive_splitter():
    text = "\n\n".join(f"Paragraph {i}. " + "word " * 30 for i in range(20))
    parts = chunking.split_recursively(text, 200, 40)
    assert all(len(p) <= 200 for p in parts)
    for i in range(20):
        assert any(f"Paragraph {i}." in p for p in parts)
    assert chunking.split_recursively("x" * 250, 100, 0) == ["x" * 100, "x" * 100, "x" * 50]
    whole = chunking.split_recursively(" ".join(f"w{i}" for i in range(200)), 50, 20)
    assert all(set(a.split()) & set(b.split()) for a, b in zip(whole, whole[1:]))


def test_header_splitter():
    parts = chunking.split_by_headers("pre\n# A\none\n## B\ntwo\n```\n# no heading\n```\n# C\nthree")
    assert parts == [("pre", {}), ("one", {"Header 1": "A"}), ("two\n```\n# no heading\n```", {"Header 1": "A", "Header 2": "B"}), ("three", {"Header 1": "C"})]


def test_by_title():
    rows = chunking.by_title_chunks("# One\n\n" + "text. " * 60 + "\n\n# Two\n\nshort.\n\n" + "y" * 2500)
    assert all(len(t) <= 1000 for _, t, _ in rows) and rows[1][1].startswith("# Two")


@pytest.mark.parametrize("threshold", chunking.BREAKS)
def test_semantic(spark, threshold):
    cats, ships = "Cats purr and cats sleep all day long. ", "Ships sail over oceans towards distant harbours. "
    vectors = lambda c: c.withColumn("embedding", F.when(F.contains("text", F.lit("purr")), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    rows = chunking.semantic_chunks(spark.createDataFrame([("d", cats * 8 + ships * 8), ("e", None), ("f", "")], "document_id string, text string"), vectors, threshold, {"percentile": 90.0, "gradient": 90.0}.get(threshold, 1.0), 0, 10)
    texts = [r.text for r in rows.orderBy("chunk_index").collect()]
    assert "".join(texts).replace(" ", "") == (cats * 8 + ships * 8).replace(" ", "")
    assert len(texts) >= 2
    assert threshold == "gradient" or not any("purr" in t and "sail" in t for t in texts)
