"""One query for each operator of the inventory, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import metadata as M
from ..functions import text as T
from ..functions import vector as V
from ..operators import cache, catalog, cells, chunking, embedding, fusion, jobs, markdown, search, segments, sync, textindex, vectorsearch
from ..operators.batches import bounded
from ..sources import files, scratch
from ..streaming import events as E
from ..streaming.store import IndexSink
from . import views
from .views import SQL_CHUNKS, SQL_COLLECTION, SQL_DOCUMENTS, sql_bm25, sql_tokens, sql_vector, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TERMS = ["thing", "tion"]
QUERY = "thing tion"

# --- identity -------------------------------------------------------------------------------------


@query(f"WITH {SQL_CHUNKS} SELECT chunk_id, document_id, chunk_index FROM c")
def chunk_identity(spark, sf_dir):
    return views.chunks(spark, sf_dir).select("chunk_id", "document_id", "chunk_index")


# --- sources and sinks ----------------------------------------------------------------------------

_PATHS = """p AS (SELECT doc_id, '/kb/' || CASE doc_id % 7 WHEN 0 THEN 'uploads/' WHEN 1 THEN '.cache/' ELSE source || '/' END || doc_id ||
  CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.MD' WHEN 2 THEN '.markdown' WHEN 3 THEN '.md' ELSE '.txt' END AS path FROM documents)"""


def _paths(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    folder = F.when(F.col("doc_id") % 7 == 0, "uploads/").when(F.col("doc_id") % 7 == 1, ".cache/").otherwise(F.concat("source", F.lit("/")))
    suffix = F.element_at(F.array(*map(F.lit, (".pdf", ".MD", ".markdown", ".md", ".txt"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select("doc_id", F.concat(F.lit("/kb/"), folder, F.col("doc_id").cast("string"), suffix).alias("path"))


@query(f"WITH {_PATHS} SELECT doc_id, path FROM p WHERE regexp_matches(lower(path), '\\.(pdf|md|markdown)$') AND doc_id % 7 NOT IN (0, 1)")
def s1_s3_scan_filter(spark, sf_dir):
    return _paths(spark, sf_dir).where(files.is_supported(F.col("path")) & ~files.is_excluded(F.col("path"), "/kb"))


@query(f"WITH {_PATHS} SELECT CASE WHEN lower(path) LIKE '%.pdf' THEN 'pdf' WHEN lower(path) LIKE '%.md' OR lower(path) LIKE '%.markdown' THEN 'markdown' ELSE 'unsupported' END AS kind, count(*) AS files FROM p GROUP BY 1")
def s4_type_router(spark, sf_dir):
    return _paths(spark, sf_dir).groupBy(files.route(F.col("path")).alias("kind")).agg(F.count("*").alias("files"))


@query("SELECT doc_id, length(trim(text, ' \t\n\r')) >= 60 AND len(list_filter(regexp_split_to_array(trim(text, ' \t\n\r'), '\\s+'), lambda x: x <> '')) >= 12 AS meaningful FROM documents")
def s8_meaningful_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.has_meaningful_text(F.col("text"), 60, 12).alias("meaningful"))


def _elements(spark, sf_dir):
    kind = F.when(F.col("turn") == 0, "Title").when(F.col("role") == "system", "Table").when(F.col("turn") % 3 == 2, "ListItem").otherwise("NarrativeText")
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("position"), kind.alias("kind"), "text", (F.floor(F.col("turn") / 2) + 1).cast("int").alias("page_number"))


_ELEMENTS = """e AS (SELECT conv_id, turn AS position, CASE WHEN turn = 0 THEN 'Title' WHEN role = 'system' THEN 'Table' WHEN turn % 3 = 2 THEN 'ListItem' ELSE 'NarrativeText' END AS kind,
  trim(text, ' \t\n\r') AS t, turn // 2 + 1 AS page_number FROM conversations)"""


@query(
    f"""WITH {_ELEMENTS} SELECT conv_id, string_agg(CASE kind WHEN 'Title' THEN repeat('#', least(len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')), 6)::INT) || ' ' || t
  WHEN 'Table' THEN '[TABLE]' || chr(10) || t || chr(10) || '[/TABLE]' WHEN 'ListItem' THEN '- ' || t ELSE t END, chr(10) || chr(10) ORDER BY position) AS markdown
  FROM e WHERE t <> '' GROUP BY conv_id"""
)
def s10_elements_to_markdown(spark, sf_dir):
    return markdown.elements_to_markdown(_elements(spark, sf_dir), "conv_id")


@query(f"WITH {_ELEMENTS} SELECT conv_id, kind, count(*) AS elements, count(DISTINCT page_number) AS pages FROM e GROUP BY conv_id, kind")
def s11_element_statistics(spark, sf_dir):
    return markdown.element_statistics(_elements(spark, sf_dir), "conv_id")


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def s12_transcription_join(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page_number"), F.col("text").alias("content"))
    return markdown.combined(pages, "conv_id", markdown.BETWEEN_PAGES)


@query(
    r"""SELECT conv_id, string_agg(CASE WHEN turn % 5 = 4 THEN '# Page ' || turn || chr(10) || chr(10) || '*[Error: Could not process this page]*' || chr(10)
  WHEN turn % 5 = 3 THEN '# Page ' || turn || chr(10) || chr(10) || '*[Error: Could not transcribe this page: no turn ' || turn || ']*' || chr(10) ELSE '> ' || text END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id"""
)
def s12_page_transcription(spark, sf_dir):
    images = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page_number"), F.when(F.col("turn") % 5 != 4, F.col("text").cast("binary")).alias("image"))

    def transcribe(image: bytes, n: int) -> str:
        if n % 5 == 3:
            raise RuntimeError(f"no turn {n}")
        return "> " + image.decode()

    return markdown.combined(markdown.transcribed(images, transcribe, 8, "conv_id"), "conv_id", markdown.BETWEEN_PAGES)


@query(
    f"""WITH {SQL_CHUNKS} SELECT coalesce(nullif(title, ''), 'Untitled') AS "Document Title", path AS "Document Path", printf('%.2f%%', (chunk_index % 101) / 100 * 100) AS "Score", NULL::VARCHAR AS "Page", chunk_index + 1 AS "Chunk Index", text AS "Content" FROM c"""
)
def s24_result_csv(spark, sf_dir):
    rows = views.chunks(spark, sf_dir).withColumn("score", F.col("chunk_index") % 101 / 100)
    return catalog.result_csv(rows)


@query("""SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":' || to_json(lang) || ',"source":' || to_json(source) || ',"n_chars":' || n_chars || '}' AS json FROM documents""")
def s25_json_rows(spark, sf_dir):
    out = catalog.as_json(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"))
    return out.select(F.get_json_object("json", "$.doc_id").cast("long").alias("doc_id"), "json")


@query("SELECT doc_id, left(sha256(source || '/' || doc_id), 16) AS cache_key FROM documents")
def s18_path_cache_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.path_key(F.concat_ws("/", "source", "doc_id")).alias("cache_key"))


# --- parsing --------------------------------------------------------------------------------------

_FRONT = "f AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '---' || chr(10) || 'title: T' || doc_id || chr(10) || 'lang: ' || lang || chr(10) || '---' || chr(10) WHEN 1 THEN '+++' || chr(10) || 'n = ' || doc_id || chr(10) || '+++' || chr(10) ELSE '' END AS head, text FROM documents)"


def _fronted(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id").cast("string")
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("---\ntitle: T"), n, F.lit("\nlang: "), "lang", F.lit("\n---\n"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("+++\nn = "), n, F.lit("\n+++\n"))).otherwise("")
    return d.select("doc_id", F.concat(head, "text").alias("text"), F.concat(F.lit("/kb/"), n, F.lit(".md")).alias("path"))


@query(
    f"""WITH {_FRONT} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'yaml' WHEN 1 THEN 'toml' END AS kind,
  CASE WHEN doc_id % 3 < 2 THEN substr(head, 5, length(head) - 9) END AS raw, md5(CASE WHEN doc_id % 3 < 2 THEN regexp_replace(text, '^\\s+', '') ELSE text END) AS body_md5, length(CASE WHEN doc_id % 3 < 2 THEN regexp_replace(text, '^\\s+', '') ELSE text END) AS chars FROM f"""
)
def p1_p2_front_matter(spark, sf_dir):
    f = _fronted(spark, sf_dir).select("doc_id", markdown.front_matter(F.col("text")).alias("f"))
    body = F.when(F.col("f.kind").isNotNull(), F.regexp_replace("f.body", r"\A\s+", "")).otherwise(F.col("f.body"))
    return f.select("doc_id", "f.kind", "f.raw", F.md5(body.cast("binary")).alias("body_md5"), F.length(body).alias("chars"))


@query(f"WITH {_FRONT} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'T' || doc_id END AS title, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN doc_id::VARCHAR END AS value FROM f JOIN documents USING (doc_id) WHERE doc_id % 3 < 2")
def p1_p2_decoded(spark, sf_dir):
    f = _fronted(spark, sf_dir).withColumn("f", markdown.front_matter(F.col("text"))).where("f.kind is not null")
    m = f.select("doc_id", markdown.decoded("f.kind", "f.raw").alias("m"))
    return m.select("doc_id", F.try_element_at("m", F.lit("title")).alias("title"), F.coalesce(F.try_element_at("m", F.lit("lang")), F.try_element_at("m", F.lit("n"))).alias("value"))


@query("SELECT doc_id, 'Guide ' || lang || ' to ' || source AS title FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 2 = 1")
def p3_heading_title(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    marked = F.concat(F.lit("intro\n# **Guide** `"), "lang", F.lit("` *to* ["), "source", F.lit("](http://x/y)\n"), "text")
    text = F.when(F.col("doc_id") % 2 == 0, marked).otherwise(F.regexp_replace("text", "#", ""))
    return d.select("doc_id", T.heading_title(text).alias("title"))


@query("SELECT doc_id, len(string_split(text, chr(10))) AS line_count, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS word_count, length(text) AS char_count FROM documents")
def p4_counts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.line_count(t).alias("line_count"), T.word_count(t).alias("word_count"), F.length(t).alias("char_count"))


@query("SELECT page_id, len(regexp_extract_all(m, '(?m)^#+\\s')) AS headings, len(regexp_extract_all(m, '\\[([^\\]]+)\\]\\(([^)]+)\\)')) AS links, len(regexp_extract_all(m, '(?m)^```')) // 2 AS code_blocks FROM (SELECT page_id, replace(replace(replace(html, '<h', chr(10) || '# <h'), '<a href=\"', chr(10) || '[x]('), '<pre', chr(10) || '```') || ')' AS m FROM pages)")
def p5_markdown_counts(spark, sf_dir):
    m = F.col("html")
    for old, new in (("<h", "\n# <h"), ('<a href="', "\n[x]("), ("<pre", "\n```")):
        m = F.replace(m, F.lit(old), F.lit(new))
    m = F.concat(m, F.lit(")"))
    return table(spark, sf_dir, "pages").select("page_id", T.heading_count(m).alias("headings"), T.link_count(m).alias("links"), T.code_block_count(m).alias("code_blocks"))


# pages: every line of a document is a page, its markers in reverse order so that sorting matters
def _marked(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    n = F.size(lines)
    marked = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("--[PAGE: "), ((n - i + 1) * 2).cast("string"), F.lit("]--\n"), F.get(lines, i - 1)))
    return d.select("doc_id", "lang", F.concat_ws("\n", F.concat(F.lit("Lead "), "lang"), F.concat_ws("\n", marked)).alias("text"))


_PAGES = """l AS (SELECT doc_id, lang, string_split(text, chr(10)) AS lines FROM documents),
pg AS (SELECT doc_id, 0 AS page_number, 'Lead ' || lang AS content, NULL AS original FROM l
  UNION ALL SELECT doc_id, len(lines) - i + 1, trim('--[PAGE: ' || ((len(lines) - i + 1) * 2) || ']--' || chr(10) || lines[i], ' ' || chr(9) || chr(10) || chr(13)), (len(lines) - i + 1) * 2
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l))"""


@query(f"WITH {_PAGES} SELECT doc_id, page_number, content, original AS original_page_number FROM pg")
def p6_p7_pages(spark, sf_dir):
    return markdown.pages(_marked(spark, sf_dir), "text", "doc_id").select("doc_id", "page_number", "content", "original_page_number")


@query(f"WITH {_PAGES} SELECT doc_id, string_agg(content, chr(10) || chr(10) ORDER BY page_number) AS content FROM pg GROUP BY doc_id")
def p8_combined_pages(spark, sf_dir):
    return markdown.combined(markdown.pages(_marked(spark, sf_dir), "text", "doc_id"), "doc_id")


@query(
    f"""WITH {SQL_DOCUMENTS}, ln AS (SELECT doc_id, unnest(list_slice(string_split(text, chr(10)), 1, 10)) AS raw, generate_subscripts(list_slice(string_split(text, chr(10)), 1, 10), 1) AS i FROM d),
  s AS (SELECT doc_id, i, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM ln),
  ok AS (SELECT doc_id, min_by(line, i) AS line FROM s WHERE (line LIKE '#%' AND length(line) > 1 AND length(trim(regexp_replace(line, '^[# ]+', ''), ' ')) BETWEEN 6 AND 199)
    OR (NOT line LIKE '#%' AND length(line) BETWEEN 6 AND 199 AND line <> upper(line) AND line <> lower(line) AND regexp_matches(left(line, 1), '\\p{{Lu}}') AND NOT contains(left(line, 50), '.')) GROUP BY doc_id)
  SELECT doc_id, coalesce(trim(regexp_replace(line, '^[# ]+', ''), ' ' || chr(9)), doc_id::VARCHAR) AS title FROM d LEFT JOIN ok USING (doc_id)"""
)
def p9_inferred_title(spark, sf_dir):
    return views.documents(spark, sf_dir).select("doc_id", T.inferred_title(F.col("text"), T.file_stem(F.col("path"))).alias("title"))


@query("SELECT doc_id, 'parser' AS source, lang AS lang, 'me' AS owner FROM documents")
def p10_metadata_precedence(spark, sf_dir):
    user = F.create_map(F.lit("source"), F.lit("user"), F.lit("owner"), F.lit("me"))
    parsed = F.create_map(F.lit("source"), F.lit("parser"), F.lit("lang"), F.col("lang"))
    m = table(spark, sf_dir, "documents").select("doc_id", M.merged(user, parsed).alias("m"))
    return m.select("doc_id", *[F.element_at("m", F.lit(k)).alias(k) for k in ("source", "lang", "owner")])


@query(f"WITH {_PAGES} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 7 ELSE count(*) END AS page_count FROM pg GROUP BY doc_id")
def p11_page_count(spark, sf_dir):
    pages = markdown.pages(_marked(spark, sf_dir), "text", "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    given = F.when(F.col("doc_id") % 4 == 0, F.lit(7).cast("long"))
    return pages.select("doc_id", F.coalesce(given, "n").alias("page_count"))


@query(f"WITH {_PAGES} SELECT doc_id, string_agg('--- Page ' || page_number || ' ---' || chr(10) || content, chr(10) || chr(10) ORDER BY page_number) AS content FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS r FROM pg) WHERE r <= 3 GROUP BY doc_id")
def p14_summary_content(spark, sf_dir):
    return markdown.summary_content(markdown.pages(_marked(spark, sf_dir), "text", "doc_id"), 3, "doc_id")


@query(
    """SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE (CASE WHEN contains(h, '.') AND length(h) - instr(reverse(h), '.') > 320 THEN left(h, length(h) - instr(reverse(h), '.') + 1) ELSE h END)
  || chr(10) || chr(10) || '[Content truncated due to length...]' END AS text FROM (SELECT doc_id, text, left(text, 400) AS h FROM documents)"""
)
def p15_truncated(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncated(F.col("text"), 100).alias("text"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN left('Title ' || lang || repeat('x', 90), 80) END AS title, CASE WHEN doc_id % 4 > 0 THEN source END AS short_description FROM documents")
def p16_parsed_summary(spark, sf_dir):
    long = F.concat(F.lit("Title "), "lang", F.repeat(F.lit("x"), F.lit(90)))
    body = F.to_json(F.struct(long.alias("title"), F.concat(F.lit("  "), "source", F.lit(" ")).alias("short_description"), F.when(F.col("doc_id") % 4 > 0, F.lit("long")).otherwise(" ").alias("long_description")))
    response = F.concat(F.lit("Here you are:\n```json\n"), body, F.lit("\n```"))
    s = table(spark, sf_dir, "documents").select("doc_id", embedding.parsed_summary(response).alias("s"))
    return s.select("doc_id", "s.title", "s.short_description")


@query(
    """SELECT doc_id, 'Report ' || upper(left(lang, 1)) || substr(lang, 2) AS title, 'Document with ' || w || ' words' AS short_description,
  'This document contains ' || w || ' words and ' || length(text) || ' characters. Automatic summarization was not available, but the document appears to contain structured content suitable for analysis.' AS long_description
  FROM (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM documents)"""
)
def p17_fallback_summary(spark, sf_dir):
    name = F.concat(F.lit("report_"), "lang", F.lit(".pdf"))
    return table(spark, sf_dir, "documents").select("doc_id", embedding.fallback_summary(F.col("text"), name).alias("s")).select("doc_id", "s.*")


@query(f"WITH {_PATHS} SELECT doc_id, split_part(path, '/', -1) AS name, doc_id::VARCHAR AS stem, lower('.' || split_part(path, '.', -1)) AS suffix FROM p")
def p18_file_name(spark, sf_dir):
    p = F.col("path")
    return _paths(spark, sf_dir).select("doc_id", T.file_name(p).alias("name"), T.file_stem(p).alias("stem"), T.file_suffix(p).alias("suffix"))


_ERRORS = "CASE doc_id % 6 WHEN 0 THEN 'Please retry after ' || doc_id WHEN 1 THEN 'Try again in ' || doc_id || 's' WHEN 2 THEN 'wait ' || doc_id || ' seconds' WHEN 3 THEN 'Rate limit hit: ' || doc_id || ' second' WHEN 4 THEN 'Retry-After: ' || doc_id ELSE 'server error' END"


@query("SELECT doc_id, CASE WHEN doc_id % 6 < 5 THEN doc_id::INT END AS seconds FROM documents")
def p19_retry_after(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.retry_after(F.expr(_ERRORS)).alias("seconds"))


@query("SELECT lang, round(sum(length(text)) / 4 / 1000000 * 0.13, 9) AS cost FROM documents GROUP BY lang")
def p20_cost(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(T.estimated_cost(F.sum(F.length("text")), 0.13), 9).alias("cost"))


# --- chunking -------------------------------------------------------------------------------------


@query()
def c1_header_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = F.regexp_replace(F.concat(F.lit("# "), "source", F.lit("\n## "), "lang", F.lit("\n"), "text"), r"\n", "\n\n")
    return chunking.chunked(d.select("doc_id", text.alias("text")), chunking.header_chunks, "doc_id").select("doc_id", "chunk_index", "text", F.concat_ws("/", F.map_values("headings")).alias("headings"))


@query()
def c2_recursive_chunks(spark, sf_dir):
    return chunking.chunked(table(spark, sf_dir, "documents"), chunking.chunker("recursive"), "doc_id").drop("headings")


@query(f"WITH {_PAGES} SELECT doc_id, page_number, CASE WHEN page_number = 0 THEN content ELSE regexp_replace(content, '^--\\[PAGE:\\s*\\d+\\]--\\s*\\n?', '') END AS text FROM pg")
def c3_page_text(spark, sf_dir):
    return markdown.pages(_marked(spark, sf_dir), "text", "doc_id").select("doc_id", "page_number", chunking.page_text(F.col("content")).alias("text"))


_FOLD = f"""WITH RECURSIVE {_PAGES}, t AS (SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS r,
    CASE WHEN page_number = 0 THEN content ELSE regexp_replace(content, '^--\\[PAGE:\\s*\\d+\\]--\\s*\\n?', '') END AS x FROM pg),
  f AS (SELECT doc_id, r, 1::BIGINT AS g, x AS open, page_number AS a, page_number AS b, 1::BIGINT AS n FROM t WHERE r = 1
    UNION ALL SELECT t.doc_id, t.r, CASE WHEN m THEN g WHEN length(open) > 0 THEN g + 1 ELSE g END,
      CASE WHEN m AND trim(x, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN open WHEN m THEN open || chr(10) || chr(10) || x ELSE x END,
      CASE WHEN m THEN a ELSE t.page_number END, CASE WHEN m AND trim(x, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN b ELSE t.page_number END,
      CASE WHEN m AND trim(x, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN n WHEN m THEN n + 1 ELSE 1 END
    FROM (SELECT f.*, t.r AS r2, t.x, t.page_number, length(open) > 0 AND length(open) < 200 AND length(t.x) < 200 AS m FROM f JOIN t ON t.doc_id = f.doc_id AND t.r = f.r + 1) j
    JOIN LATERAL (SELECT j.doc_id AS doc_id, j.r2 AS r, j.page_number AS page_number) t ON true),
  z AS (SELECT doc_id, g, arg_max(open, r) AS text, arg_max(a, r) AS a, arg_max(b, r) AS b, arg_max(n, r) AS n FROM f GROUP BY doc_id, g)"""


@query(
    _FOLD
    + """ SELECT doc_id, row_number() OVER w - 1 AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, text, CASE WHEN n = 1 THEN a END AS page_number, CASE WHEN n > 1 THEN a || '-' || b END AS page_range FROM z WHERE length(text) > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY g)"""
)
def c4_c6_c7_page_chunks(spark, sf_dir):
    pages = markdown.pages(_marked(spark, sf_dir), "text", "doc_id")
    return chunking.page_chunks(pages, 200, key="doc_id").select("doc_id", "chunk_index", "total_chunks", "text", "page_number", "page_range")


@query()
def c5_split_page_chunks(spark, sf_dir):
    pages = markdown.pages(_marked(spark, sf_dir), "text", "doc_id")
    return chunking.page_chunks(pages, 200, 600, key="doc_id").select("doc_id", "chunk_index", "text", "split_part", "split_total")


@query("SELECT doc_id, text FROM documents")
def c8_whole_text(spark, sf_dir):
    return chunking.whole_texts(table(spark, sf_dir, "documents"), key="doc_id").select("doc_id", "text")


@query()
def c9_semantic_chunks(spark, sf_dir):
    return chunking.semantic_chunks(table(spark, sf_dir, "documents"), functools.partial(embedding.with_hashed, text=False), key="doc_id")


@query()
def c10_by_title_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\n", "\n\n").alias("text"))
    return chunking.chunked(d, chunking.chunker("by_title"), "doc_id").drop("headings")


@query(f"WITH {_PAGES}, j AS (SELECT doc_id, string_agg('# Page ' || page_number || chr(10) || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY page_number) AS text FROM pg GROUP BY doc_id) SELECT doc_id, text, regexp_extract(text, '# Page (\\d+)', 1)::INT AS first_page FROM j")
def c11_page_headers(spark, sf_dir):
    t = chunking.with_page_headers(markdown.pages(_marked(spark, sf_dir), "text", "doc_id"), "doc_id")
    return t.select("doc_id", "text", chunking.recovered_page(F.col("text")).alias("first_page"))


@query(f"WITH {SQL_CHUNKS} SELECT chunk_id FROM c WHERE length(trim(text, ' ' || chr(9) || chr(13))) >= 100")
def c12_minimum_size(spark, sf_dir):
    return chunking.large_enough(views.chunks(spark, sf_dir), 100).select("chunk_id")


# --- embedding, reranking, summaries ---------------------------------------------------------------

_HASHED = f"""tk AS (SELECT id, unnest({sql_tokens('text')}) AS t FROM src),
  hs AS (SELECT id, ('0x' || substr(md5(t), 1, 6))::BIGINT % 64 AS i, sum(CASE WHEN ('0x' || substr(md5(t), 7, 1))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END) AS s FROM tk GROUP BY ALL),
  nm AS (SELECT id, sqrt(sum(s * s)) AS n FROM hs GROUP BY id)"""


@query(f"WITH src AS (SELECT doc_id AS id, text FROM documents), {_HASHED} SELECT id AS doc_id, i AS dimension, round((s::DOUBLE / nullif(n, 0)::DOUBLE)::FLOAT::DOUBLE, 5) AS value FROM hs JOIN nm USING (id) WHERE s <> 0")
def e1_hashed_embedding(spark, sf_dir):
    v = embedding.with_hashed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return v.select("doc_id", F.posexplode("embedding").alias("dimension", "v")).where("v <> 0").select("doc_id", F.col("dimension").cast("long").alias("dimension"), F.round(F.col("v").cast("double"), 5).alias("value"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm FROM embeddings")
def e2_normalised(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 5).alias("norm"))


#: Vectors as eight tokens of eight numbers, of which a mask leaves some out.
_MASKED = "list_filter(range(8), lambda i: (vec_id + i) % 3 <> 0)"


@query(
    f"""SELECT vec_id, round((list_sum(list_transform({_MASKED}, lambda i: embedding[i * 8 + 1]::DOUBLE)) / len({_MASKED}))::FLOAT::DOUBLE, 4) AS first,
  round((list_sum(list_transform({_MASKED}, lambda i: embedding[i * 8 + 8]::DOUBLE)) / len({_MASKED}))::FLOAT::DOUBLE, 4) AS last FROM embeddings"""
)
def e2_mean_pooling(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when((F.col("vec_id") + i) % 3 == 0, 0).otherwise(1))
    pooled = e.select("vec_id", V.mean_pooled(parts, mask).alias("p"))
    return pooled.select("vec_id", F.round(F.get("p", F.lit(0)).cast("double"), 4).alias("first"), F.round(F.get("p", F.lit(7)).cast("double"), 4).alias("last"))


@query("SELECT doc_id, CASE WHEN md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0) THEN -1 ELSE length(text) END::DOUBLE AS value FROM documents")
def e3_embedding_cache(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = d.where("doc_id % 3 = 0").select(F.md5(F.col("text").cast("binary")).alias("text_hash")).distinct().withColumn("embedding", F.array(F.lit(-1.0).cast("float")))
    out = embedding.embedded(d, lambda texts: [[float(len(t))] for t in texts], cache=known)
    return out.select("doc_id", F.get("embedding", F.lit(0)).cast("double").alias("value"))


@query(f"WITH {SQL_COLLECTION} SELECT chunk_id FROM c WHERE embedding IS NOT NULL AND len(embedding) > 0")
def e7_stored_with_vectors(spark, sf_dir):
    return embedding.with_vectors(views.collection(spark, sf_dir).chunks).select("chunk_id")


@query("SELECT event_id, round(CASE WHEN value IS NULL OR isnan(value) THEN 0 ELSE 1 / (1 + exp(0.5 - value / 100)) END, 6) AS p FROM events")
def e8_yes_probability(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(embedding.yes_probability(F.col("value") / 100, F.lit(0.5)), 6).alias("p"))


@query("SELECT event_id, greatest(0, least(1, value / 50 - 0.5)) AS score FROM events")
def e9_clamped(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", embedding.clamped(F.col("value") / 50 - 0.5).alias("score"))


@query("SELECT item_id, item_id::INT + 1 AS rank, 1.0::DOUBLE AS score, 'reranked' AS search_type FROM benchmark WHERE item_id < 10")
def e10_failed_rerank(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") + 1).alias("rank")).orderBy("rank", "item_id").limit(10)
    return embedding.reranked(rows, None, 10, "item_id").select("item_id", "rank", "score", "search_type")


@query("SELECT doc_id, CASE WHEN length(left(text, doc_id::INT % 12)) > 5 THEN left(text, doc_id::INT % 12) ELSE lang END AS title FROM documents")
def e12_accepted_title(spark, sf_dir):
    short = F.left("text", (F.col("doc_id") % 12).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", embedding.accepted_title(short, F.col("lang")).alias("title"))


# --- search ---------------------------------------------------------------------------------------

VEC = 7


@query(f"WITH {SQL_COLLECTION}, {sql_vector(VEC)} SELECT chunk_id, score FROM v ORDER BY distance, chunk_id LIMIT 20")
def q1_vector_search(spark, sf_dir):
    c = views.collection(spark, sf_dir)
    return vectorsearch.search(c.chunks, views.query_vector(spark, sf_dir, VEC), 20).select("chunk_id", "score")


_NEAREST = """WITH r AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_sum(list_transform(list_zip(c.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS d
  FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 6), id) AS rank FROM r) SELECT query_id, rank::INT AS rank, id, round(greatest(0, 1 - d / 2), 6) AS score FROM k WHERE rank <= 5"""


@query(_NEAREST)
def q1_vector_search_batch(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectorsearch.search_batch(e, queries, 5, "vec_id")


@query(_NEAREST)
def q1_vector_cells_batch(spark, sf_dir):
    """By cells of a stored collection: two inserts, then only the cells that the triangle inequality leaves."""
    e = table(spark, sf_dir, "embeddings")
    stored = cells.VectorCells.build(e.where("vec_id % 3 <> 1"), scratch.folder(spark, "vectors"), "vec_id").inserted(e, "vec_id")
    return stored.search(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5)


@query(f"WITH {SQL_CHUNKS}, {sql_bm25(TERMS)} SELECT chunk_id, document_id, score FROM t ORDER BY score DESC, chunk_id LIMIT 10")
def bm25_search(spark, sf_dir):
    return textindex.search(textindex.TextIndex.build(views.chunks(spark, sf_dir)), QUERY, 10)


@query(f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents) GROUP BY term")
def q3_standard_analyzer(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(textindex.analysed(F.col("text"))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("tf"), F.countDistinct("doc_id").alias("df"))


@query()
def q3_stemming_analyzer(spark, sf_dir):
    t = bounded(table(spark, sf_dir, "documents")).select("doc_id", F.explode(textindex.analysed(F.col("text"), "stemming")).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("tf"), F.countDistinct("doc_id").alias("df"))


@query(f"WITH {SQL_CHUNKS}, {sql_bm25(TERMS, every=False)} SELECT chunk_id, score FROM t ORDER BY score DESC, chunk_id LIMIT 25")
def q4_or_query(spark, sf_dir):
    return textindex.search(textindex.TextIndex.build(views.chunks(spark, sf_dir)), " OR ".join(TERMS), 25).select("chunk_id", "score")


@query(
    f"WITH {SQL_CHUNKS}, {sql_bm25(['thing', 'tion'], every=False)} SELECT chunk_id FROM t WHERE chunk_id IN (SELECT chunk_id FROM t_h WHERE term = 'thing') AND chunk_id NOT IN (SELECT chunk_id FROM t_h WHERE term = 'tion')"
)
def q4_not_query(spark, sf_dir):
    return textindex.search(textindex.TextIndex.build(views.chunks(spark, sf_dir)), "thing NOT tion", None).select("chunk_id")


@query(f"WITH {SQL_CHUNKS} SELECT chunk_id FROM c WHERE contains(' ' || array_to_string({sql_tokens('text')}, ' ') || ' ', ' eainan ertionnd ')")
def q4_phrase_query(spark, sf_dir):
    return textindex.search(textindex.TextIndex.build(views.chunks(spark, sf_dir)), '"eainan ertionnd"', None).select("chunk_id")


@query(f"WITH {SQL_CHUNKS} SELECT DISTINCT chunk_id FROM (SELECT chunk_id, unnest({sql_tokens('text')}) AS t FROM c) WHERE t LIKE 'thing%'")
def q4_wildcard_query(spark, sf_dir):
    return textindex.search(textindex.TextIndex.build(views.chunks(spark, sf_dir)), "thing*", None).select("chunk_id")


_ASKED = f"""a AS (SELECT item_id AS query_id, unnest(list_distinct({sql_tokens("text")})) AS term FROM benchmark),
wn AS (SELECT query_id, count(*) AS wanted FROM a GROUP BY 1)"""


def _bm25_batch_sql(cut: int) -> str:
    return f"""{_ASKED}, tok AS (SELECT *, {sql_tokens('text')} AS terms FROM c), st AS (SELECT count(*) AS n, avg(len(terms)) AS ml FROM tok),
  p AS (SELECT chunk_id, document_id, len(terms) AS length, unnest(terms) AS term FROM tok), h AS (SELECT term, chunk_id, document_id, length, count(*) AS tf FROM p WHERE term IN (SELECT term FROM a) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM h GROUP BY term),
  w AS (SELECT query_id, chunk_id, document_id, round(sum((ln(st.n / (df + 1)) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / ml))), 6) AS score, count(*) AS n FROM h JOIN df USING (term) JOIN a USING (term), st GROUP BY ALL),
  tb AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank, chunk_id, document_id, score FROM w JOIN wn USING (query_id) WHERE w.n = wanted QUALIFY rank <= {cut})"""


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_TOKENS = f"{SQL_CHUNKS}, u AS (SELECT chunk_id, unnest({sql_tokens('text')}) AS t FROM c)"


@query(f"WITH {_TOKENS} SELECT DISTINCT chunk_id FROM u WHERE t LIKE '%tion' OR t LIKE 'th%ng'")
def q4_inner_wildcard_query(spark, sf_dir):
    return textindex.search(textindex.TextIndex.build(views.chunks(spark, sf_dir)), "*tion OR th*ng", None).select("chunk_id")


@query(f"WITH {_TOKENS} SELECT DISTINCT chunk_id FROM u WHERE levenshtein(t, 'thing') <= 1 OR levenshtein(t, 'tionering') <= 2")
def q4_fuzzy_query(spark, sf_dir):
    return textindex.search(textindex.TextIndex.build(views.chunks(spark, sf_dir)), "thing~ OR tionering~2", None).select("chunk_id")


@query(f"WITH {_TOKENS} SELECT DISTINCT chunk_id FROM u WHERE t >= 'thing' AND t < 'thio' OR t > 'tiona' AND t <= 'tionb'")
def q4_term_range_query(spark, sf_dir):
    return textindex.search(textindex.TextIndex.build(views.chunks(spark, sf_dir)), "[thing TO thio} OR {tiona TO tionb]", None).select("chunk_id")


@query(
    f"""WITH {SQL_CHUNKS}, tt AS (SELECT chunk_id, {sql_tokens('text')} AS t FROM c), p AS (SELECT chunk_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM tt)
SELECT DISTINCT a.chunk_id FROM p a JOIN p b USING (chunk_id) WHERE a.w = 'thing' AND b.w = 'tion' AND b.i > a.i AND b.i - a.i <= 40"""
)
def q4_phrase_distance_query(spark, sf_dir):
    return textindex.search(textindex.TextIndex.build(views.chunks(spark, sf_dir)), '"thing tion"~40', None).select("chunk_id")


@query(f"WITH {SQL_CHUNKS}, {sql_bm25(['thing'])} SELECT t.chunk_id, t.score FROM t JOIN c USING (chunk_id) WHERE chunk_index >= 2 AND chunk_index < 9 ORDER BY score DESC, chunk_id LIMIT 40")
def q4_field_range_query(spark, sf_dir):
    c = views.chunks(spark, sf_dir)
    return textindex.search(textindex.TextIndex.build(c), "thing chunk_index:[2 TO 9}", 40, chunks=c).select("chunk_id", "score")


def _analysed(chunks):
    return chunks.select("chunk_id", "document_id", textindex.analysed(F.col("text")).alias("terms"))


@query(f"WITH {SQL_CHUNKS}, {sql_bm25(TERMS, every=False)} SELECT chunk_id, document_id, score FROM t ORDER BY score DESC, chunk_id LIMIT 10")
def q2_block_max_search(spark, sf_dir):
    """By bounds of blocks, over an index of segments."""
    index = segments.Segments.open(spark, scratch.folder(spark, "text")).changed(_analysed(views.chunks(spark, sf_dir)))
    return textindex.search(index.text_index(), " OR ".join(TERMS), 10)


@query(f"WITH {SQL_COLLECTION}, {_bm25_batch_sql(10)} SELECT * FROM tb")
def q2_block_max_batch(spark, sf_dir):
    index = segments.Segments.open(spark, scratch.folder(spark, "text")).changed(_analysed(views.collection(spark, sf_dir).chunks))
    return index.search_batch(_asked(spark, sf_dir), 10).top()


_CHANGED = SQL_CHUNKS.replace("\nc AS (", "\nc0 AS (") + """,
c AS (SELECT chunk_id, document_id, CASE WHEN doc_id % 7 = 2 THEN 'thing ' || text ELSE text END AS text FROM c0 WHERE doc_id % 11 <> 3)"""


_STREAMED = SQL_CHUNKS.replace("FROM d))", "FROM (SELECT doc_id, document_id, path, title, lang, source, CASE WHEN doc_id % 6 = 1 THEN 'thing tion' ELSE text END AS text FROM d WHERE doc_id % 9 <> 4)))")


@query(f"WITH {_STREAMED}, {sql_bm25(TERMS, every=False)} SELECT chunk_id, document_id, score FROM t ORDER BY score DESC, chunk_id LIMIT 25")
def t5_changes_applied(spark, sf_dir):
    """Batches of changes as a stream brings them, one of them twice: all documents come, some change, some go."""
    sink = IndexSink(scratch.folder(spark, "applied"))
    d = views.documents(spark, sf_dir).select("doc_id", "document_id", "text")
    event = lambda rows, kind, at, text="text": rows.select("document_id", F.lit(kind).alias("event_type"), F.expr(text).alias("text"), F.timestamp_seconds(F.lit(at)).alias("ts"))
    later = event(d.where("doc_id % 6 = 1"), "modified", 20, "'thing tion'").unionByName(event(d.where("doc_id % 9 = 4"), "deleted", 30, "CAST(NULL AS STRING)"))
    sink(event(d, "created", 10), 0)
    sink(later, 1)
    sink(event(d, "deleted", 40), 1)  # a batch of a number that has been applied
    return textindex.search(sink.index(spark), " OR ".join(TERMS), 25)


@query(f"WITH {_CHANGED}, {sql_bm25(TERMS, every=False)} SELECT chunk_id, document_id, score FROM t ORDER BY score DESC, chunk_id LIMIT 25")
def s17_index_after_changes(spark, sf_dir):
    """Four fifths of the documents, then the others together with changed texts, then without some: three changes, none of which rewrites the index."""
    c = views.chunks(spark, sf_dir)
    index = segments.Segments.open(spark, scratch.folder(spark, "text")).changed(_analysed(c.where("doc_id % 5 <> 1")))
    changed = c.withColumn("text", F.when(F.col("doc_id") % 7 == 2, F.concat(F.lit("thing "), "text")).otherwise(F.col("text")))
    index = index.changed(_analysed(changed.where("doc_id % 5 = 1 OR doc_id % 7 = 2")))
    index = index.changed(documents=c.where("doc_id % 11 = 3").select("document_id"))
    return textindex.search(index.text_index(), " OR ".join(TERMS), 25)


@query(f"WITH {SQL_COLLECTION}, {_bm25_batch_sql(10)} SELECT * FROM tb")
def q2_text_search_batch(spark, sf_dir):
    return textindex.search_batch(views.collection(spark, sf_dir).index, _asked(spark, sf_dir), 10)


@query(
    f"""WITH {SQL_COLLECTION}, {_bm25_batch_sql(20)},
  vd AS (SELECT q.vec_id AS query_id, x.chunk_id, round(list_sum(list_transform(list_zip(x.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 6) AS d
    FROM embeddings q, c x WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND x.embedding IS NOT NULL),
  vb AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM vd QUALIFY rank <= 20),
  f AS (SELECT query_id, chunk_id, round(coalesce(0.6 / (60 + vb.rank), 0) + coalesce(0.4 / (60 + tb.rank), 0), 6) AS score FROM vb FULL JOIN tb USING (query_id, chunk_id))
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank, chunk_id, score FROM f QUALIFY rank <= 10"""
)
def q6_hybrid_search_batch(spark, sf_dir):
    c = views.collection(spark, sf_dir)
    asked = _asked(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding").join(asked.select("query_id"), "query_id", "left_semi")
    near = vectorsearch.search_batch(c.chunks, vectors, 20).withColumnRenamed("id", "chunk_id")
    return fusion.fused_batch(near, textindex.search_batch(c.index, asked, 20), 10)


_HIT = "chunk_id, document_id, path, title, score"


@query(f"WITH {SQL_COLLECTION}, {sql_bm25(['thing', 'tion'])} SELECT t.chunk_id, t.document_id, c.path, c.title, t.score, 'text' AS search_type FROM t JOIN c USING (chunk_id) WHERE t.score >= 0.5 ORDER BY t.score DESC, t.chunk_id LIMIT 10")
def q5_text_search(spark, sf_dir):
    return search.search(views.collection(spark, sf_dir), QUERY, 10, search_type="text", min_score=0.5).select(*_HIT.split(", "), "search_type")


def _hybrid_sql(limit: int, cut: int, condition: str = "true", finish: str = "") -> str:
    return f"""WITH {SQL_COLLECTION}, {sql_bm25(['thing', 'tion'])}, {sql_vector(VEC)},
va AS (SELECT chunk_id, score, row_number() OVER (ORDER BY distance, chunk_id) AS r FROM v JOIN c USING (chunk_id) WHERE {condition} QUALIFY r <= {cut}),
ta AS (SELECT chunk_id, t.score, row_number() OVER (ORDER BY t.score DESC, chunk_id) AS r FROM t JOIN c USING (chunk_id) WHERE {condition} QUALIFY r <= {cut}),
h AS (SELECT chunk_id, round(coalesce(0.6 / (60 + va.r), 0) + coalesce(0.4 / (60 + ta.r), 0), 6) AS score, va.score AS vector_score, ta.score AS text_score FROM va FULL JOIN ta USING (chunk_id)),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM h QUALIFY rank <= {limit}) {finish}"""


@query(_hybrid_sql(10, 20, finish="SELECT chunk_id, score, vector_score, text_score, rank::INT AS rank FROM r"))
def q6_q8_hybrid_search(spark, sf_dir):
    c = views.collection(spark, sf_dir)
    return search.search(c, QUERY, 10, vector=views.query_vector(spark, sf_dir, VEC)).select("chunk_id", "score", "vector_score", "text_score", "rank")


@query(
    f"""WITH {SQL_COLLECTION}, v AS (SELECT chunk_id, row_number() OVER (ORDER BY n_chars DESC, chunk_id) AS r, n_chars::DOUBLE AS score FROM c QUALIFY r <= 50),
  t AS (SELECT chunk_id, row_number() OVER (ORDER BY n_chars % 97 DESC, chunk_id) AS r, (n_chars % 97)::DOUBLE AS score FROM c QUALIFY r <= 50)
  SELECT chunk_id, round(coalesce(0.5 / (60 + v.r), 0) + coalesce(0.5 / (60 + t.r), 0), 6) AS score, v.score AS vector_score, t.score AS text_score FROM v FULL JOIN t USING (chunk_id) ORDER BY 2 DESC, 1 LIMIT 100"""
)
def q7_reciprocal_rank_fusion(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.format_string("c%06d", "doc_id").alias("chunk_id"), "n_chars")
    v = d.withColumn("score", F.col("n_chars").cast("double")).orderBy(F.desc("score"), "chunk_id").limit(50)
    t = d.withColumn("score", (F.col("n_chars") % 97).cast("double")).orderBy(F.desc("score"), "chunk_id").limit(50)
    order = (F.desc("score"), "chunk_id")
    return fusion.reciprocal_rank_fusion(fusion.ranked(v, *order), fusion.ranked(t, *order), 100, 0.5, 0.5)


@query(
    _hybrid_sql(
        5, 10,
        finish="""SELECT 'hybrid' AS route, 'hybrid' AS search_type, chunk_id, score FROM r
  UNION ALL (SELECT 'vector', 'vector', chunk_id, score FROM v ORDER BY distance, chunk_id LIMIT 5)
  UNION ALL (SELECT 'text', 'text', chunk_id, score FROM t ORDER BY score DESC, chunk_id LIMIT 5)
  UNION ALL (SELECT 'hybrid without an embedder', 'text', chunk_id, score FROM t ORDER BY score DESC, chunk_id LIMIT 5)""",
    )
)
def q9_router(spark, sf_dir):
    c, vector = views.collection(spark, sf_dir), views.query_vector(spark, sf_dir, VEC)
    routes = [("hybrid", "hybrid", vector), ("vector", "vector", vector), ("text", "text", None), ("hybrid without an embedder", "hybrid", None)]
    out = [search.search(c, QUERY, 5, search_type=kind, vector=v).select(F.lit(name).alias("route"), "search_type", "chunk_id", "score") for name, kind, v in routes]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


_OVERLAP = f"round(len(list_intersect(list_distinct({sql_tokens('c.text')}), ['thing', 'tion', 'ering'])) / 3, 6)"


@query(
    f"""WITH {SQL_COLLECTION}, {sql_vector(VEC)}, w AS (SELECT chunk_id, row_number() OVER (ORDER BY distance, chunk_id) AS r FROM v QUALIFY r <= 15)
  SELECT chunk_id, {_OVERLAP} AS score, (row_number() OVER (ORDER BY {_OVERLAP} DESC, r, chunk_id))::INT AS rank, 'reranked' AS search_type FROM w JOIN c USING (chunk_id) QUALIFY rank <= 10"""
)
def q10_reranked_search(spark, sf_dir):
    c = views.collection(spark, sf_dir)
    return search.search(c, "thing tion ering", 10, search_type="vector", vector=views.query_vector(spark, sf_dir, VEC), rerank=embedding.overlap).select("chunk_id", "score", "rank", "search_type")


@query(_hybrid_sql(10, 20, "lang = 'en' AND source IN ('src0', 'src1', 'src2', 'src3', 'src4') AND n_chars > 300", "SELECT chunk_id, score, rank::INT AS rank FROM r"))
def q11_filtered_hybrid_search(spark, sf_dir):
    where = {"lang": "en", "doc_source": ["src0", "src1", "src2", "src3", "src4"], "n_chars": {"$gt": 300}}
    c = views.collection(spark, sf_dir)
    return search.search(c, QUERY, 10, where, vector=views.query_vector(spark, sf_dir, VEC)).select("chunk_id", "score", "rank")


@query("SELECT doc_id FROM documents WHERE (lang = 'en' OR n_chars > 2000) AND source NOT IN ('src1', 'src2') AND n_chars <= 5000 AND lang <> 'de'")
def q11_metadata_predicate(spark, sf_dir):
    where = {"$or": [{"lang": "en"}, {"n_chars": {"$gt": 2000}}], "source": {"$nin": ["src1", "src2"]}, "n_chars": {"$lte": 5000}, "lang": {"$ne": "de"}}
    d = views.documents(spark, sf_dir).drop("lang", "source", "n_chars")
    return d.where(M.predicate(where, d.columns, F.col("metadata"))).select("doc_id")


_COARSE = f"{sql_bm25(['thing', 'tion'])}, k AS (SELECT document_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM t QUALIFY r <= 80), s AS (SELECT document_id, min(r)::INT AS rank FROM k GROUP BY 1 ORDER BY 2 LIMIT 8)"


@query(f"WITH {SQL_CHUNKS}, {_COARSE} SELECT document_id, rank FROM s")
def q12_coarse_documents(spark, sf_dir):
    c = search.Collection(views.chunks(spark, sf_dir), views.documents(spark, sf_dir))
    return search.coarse_documents(c, QUERY, 8)


@query(
    f"""WITH {SQL_COLLECTION}, {sql_bm25(['thing', 'tion'])}, k AS (SELECT document_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM t QUALIFY r <= 30), s AS (SELECT document_id, min(r) AS rank FROM k GROUP BY 1 ORDER BY 2 LIMIT 3)
  SELECT chunk_id, document_id, score FROM t WHERE document_id IN (SELECT document_id FROM s) ORDER BY score DESC, chunk_id LIMIT 5"""
)
def q13_scoped_search(spark, sf_dir):
    c = views.collection(spark, sf_dir, search.Settings(scope_threshold=100, scope_documents=3))
    return search.scoped_search(c, QUERY, "session", search.Scopes(), 0.0, 5, search_type="text").select("chunk_id", "document_id", "score")


@query(f"WITH {SQL_CHUNKS} SELECT count(DISTINCT document_id) AS documents FROM c")
def q14_corpus_size(spark, sf_dir):
    return catalog.document_count(views.chunks(spark, sf_dir))


@query(f"WITH {SQL_CHUNKS}, {sql_bm25(TERMS, every=False)} SELECT chunk_id, score FROM (SELECT * FROM t ORDER BY score DESC, chunk_id LIMIT 25) ORDER BY score DESC, chunk_id LIMIT 5 OFFSET 10")
def q15_paging(spark, sf_dir):
    hits = textindex.search(textindex.TextIndex.build(views.chunks(spark, sf_dir)), " OR ".join(TERMS), 25).orderBy(F.desc("score"), "chunk_id")
    return search.page(hits, 5, "10", 25)[0].select("chunk_id", "score")


@query(
    f"""WITH {SQL_COLLECTION}, {sql_vector(VEC, condition="c.document_id <> (SELECT document_id FROM d ORDER BY path LIMIT 1)")}
  SELECT chunk_id, document_id, score FROM (SELECT *, row_number() OVER (ORDER BY distance, chunk_id) AS r FROM v QUALIFY r <= 6) WHERE score >= 0.1 AND r <= 5"""
)
def q16_similar_documents(spark, sf_dir):
    c = views.collection(spark, sf_dir)
    first = c.documents.orderBy("path").select("document_id").first().document_id
    return search.similar_documents(c, first, 5, "vector", vector=views.query_vector(spark, sf_dir, VEC)).select("chunk_id", "document_id", "score")


@query(
    f"""WITH {SQL_DOCUMENTS}, w AS (SELECT unnest(regexp_split_to_array(lower(title), '\\s+')) AS w FROM d), b AS (SELECT w, count(*) AS n FROM w WHERE length(w) > 3 AND contains(w, 'tion') GROUP BY w ORDER BY n DESC, w LIMIT 10)
  SELECT upper(left(w, 1)) || substr(w, 2) AS suggestion, (row_number() OVER (ORDER BY n DESC, upper(left(w, 1)) || substr(w, 2)))::INT AS rank FROM b"""
)
def q17_suggestions(spark, sf_dir):
    return search.suggestions(views.documents(spark, sf_dir), "tion")


@query("SELECT doc_id, regexp_replace(text, '(thing|the)', '<mark>\\1</mark>', 'gi') AS text FROM documents")
def q18_highlight(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.highlighted(F.col("text"), ["the", "thing"]).alias("text"))


@query(f"WITH {SQL_COLLECTION}, {sql_bm25(['thing', 'tion'])}, h AS (SELECT * FROM t ORDER BY score DESC, chunk_id LIMIT 5) SELECT 'thing tion' AS query, count(*) AS total_results, max(score) AS best FROM h")
def q19_search_envelope(spark, sf_dir):
    hits = search.search(views.collection(spark, sf_dir), QUERY, 5, search_type="text")
    return hits.agg(F.lit(QUERY).alias("query"), F.count("*").alias("total_results"), F.max("score").alias("best"))


@query(
    f"WITH {SQL_COLLECTION}, {sql_bm25(['thing', 'tion'])}, h AS (SELECT document_id FROM t ORDER BY score DESC, chunk_id LIMIT 1) SELECT document_id, 'Document with ' || len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) || ' words' AS summary FROM d JOIN h USING (document_id)"
)
def q20_search_and_summary(spark, sf_dir):
    c = views.collection(spark, sf_dir)
    top = search.search(c, QUERY, 1, search_type="text").select("document_id")
    whole = catalog.contents(c.chunks.join(F.broadcast(top), "document_id", "left_semi"))
    return whole.select("document_id", embedding.fallback_summary(F.col("content"), F.lit("")).getField("short_description").alias("summary"))


# --- catalogue ------------------------------------------------------------------------------------


@query(f"WITH {SQL_CHUNKS} SELECT document_id, min(title) AS title, min(path) AS path, count(*) AS chunk_count FROM c GROUP BY document_id")
def a1_list_documents(spark, sf_dir):
    return catalog.list_from_chunks(views.chunks(spark, sf_dir))


@query(f"WITH {SQL_CHUNKS} SELECT count(DISTINCT nullif(document_id, '')) AS documents FROM c")
def a2_document_count(spark, sf_dir):
    return catalog.document_count(views.chunks(spark, sf_dir))


@query(f"WITH {SQL_CHUNKS} SELECT count(*) AS chunks FROM c")
def a3_chunk_count(spark, sf_dir):
    return catalog.chunk_count(views.chunks(spark, sf_dir))


def _some_id(spark, sf_dir) -> str:
    return views.documents(spark, sf_dir).where("doc_id = 5").select("document_id").first().document_id


@query(f"WITH {SQL_CHUNKS} SELECT chunk_id, chunk_index, text FROM c WHERE doc_id = 5")
def a4_document_chunks(spark, sf_dir):
    return catalog.document_chunks(views.chunks(spark, sf_dir), _some_id(spark, sf_dir)).select("chunk_id", "chunk_index", "text")


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def a5_contents(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), "text")
    return catalog.contents(c).withColumnRenamed("document_id", "conv_id")


@query(f"WITH {SQL_CHUNKS}, i(chunk_index) AS (VALUES (0), (1), (2), (99999)) SELECT i.chunk_index, c.text, c.text IS NULL AS missing FROM i LEFT JOIN c ON c.doc_id = 5 AND c.chunk_index = i.chunk_index")
def a6_chunks_by_index(spark, sf_dir):
    return catalog.chunks_at(views.chunks(spark, sf_dir), _some_id(spark, sf_dir), "0,1,2,99999")


@query(f"WITH {SQL_DOCUMENTS} SELECT document_id, path FROM d WHERE doc_id = 5")
def a7_resolve_path(spark, sf_dir):
    path = views.documents(spark, sf_dir).where("doc_id = 5").select("path").first().path
    return catalog.resolved(views.documents(spark, sf_dir), path.removeprefix("/kb/"), "/kb").select("document_id", "path")


@query(f"WITH {SQL_CHUNKS} SELECT document_id, count(*) AS chunks, string_agg(chunk_id, ',' ORDER BY chunk_index) AS chunk_ids FROM c GROUP BY document_id")
def a8_document_with_chunks(spark, sf_dir):
    c = views.chunks(spark, sf_dir)
    d = catalog.with_chunks(views.documents(spark, sf_dir).select("document_id"), c.select("document_id", "chunk_index", "chunk_id"))
    return d.select("document_id", F.size("chunks").cast("long").alias("chunks"), F.concat_ws(",", F.transform("chunks", lambda x: x["chunk_id"])).alias("chunk_ids"))


@query(f"WITH {SQL_DOCUMENTS} SELECT document_id, path, title, count(*) OVER () AS total FROM d")
def a9_list_all(spark, sf_dir):
    return catalog.listed_all(views.documents(spark, sf_dir))


@query("SELECT doc_id FROM documents WHERE lang = 'fr' AND source IN ('src1', 'src2', 'src3')")
def a10_metadata_filter(spark, sf_dir):
    d = views.documents(spark, sf_dir).drop("lang", "source")
    return catalog.filtered(d, {"lang": "fr", "source": ["src1", "src2", "src3"]}).select("doc_id")


@query(f"WITH {SQL_DOCUMENTS} SELECT document_id FROM d ORDER BY doc_id DESC, document_id LIMIT 20 OFFSET 20")
def a11_sorted_page(spark, sf_dir):
    return catalog.listed(views.documents(spark, sf_dir), 2, 20)[0].select("document_id")


_JOBS = "j AS (SELECT event_id, '/kb/new/' || event_id || '.md' AS path, CASE event_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'pending' WHEN 2 THEN 'processing' ELSE 'failed' END AS status FROM events)"


def _jobs(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ("completed", "pending", "processing", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("/kb/new/"), F.col("event_id").cast("string"), F.lit(".md")).alias("path"), status.alias("status"))


@query(f"WITH {SQL_DOCUMENTS}, {_JOBS} SELECT document_id, path, 'completed' AS processing_status FROM d UNION ALL SELECT NULL, path, status FROM j WHERE status <> 'completed'")
def a12_with_pending(spark, sf_dir):
    return catalog.with_pending(views.documents(spark, sf_dir), _jobs(spark, sf_dir))


@query(f"WITH {SQL_DOCUMENTS} SELECT doc_id FROM d WHERE contains(lower(title), 'src1') OR contains(lower(path), 'src1') OR contains(lower(title), 'src1')")
def a13_substring_filter(spark, sf_dir):
    return catalog.matching(views.documents(spark, sf_dir), "SRC1").select("doc_id")


@query(f"WITH {SQL_CHUNKS} SELECT (SELECT count(*) FROM d) AS documents, count(*) AS chunks, round(count(*) / (SELECT count(*) FROM d), 2) AS chunks_per_document FROM c")
def a14_statistics(spark, sf_dir):
    return catalog.statistics(views.documents(spark, sf_dir), views.chunks(spark, sf_dir))


@query("SELECT coalesce(CASE WHEN lang <> 'en' THEN lang END, 'pdf') AS document_type, count(*) AS documents FROM documents GROUP BY 1")
def a14_by_type(spark, sf_dir):
    return catalog.by_type(table(spark, sf_dir, "documents").withColumn("document_type", F.when(F.col("lang") != "en", F.col("lang"))))


@query("SELECT count(*) AS documents, round(count(*) / ((max(doc_id) - min(doc_id)) * 60 / 3600), 2) AS documents_per_hour FROM documents")
def a15_throughput(spark, sf_dir):
    return catalog.throughput(views.documents(spark, sf_dir))


@query("SELECT count(*) AS files, sum(n_chars)::BIGINT AS bytes, round(sum(n_chars) / 1048576, 2) AS megabytes FROM documents")
def a16_storage(spark, sf_dir):
    return catalog.storage(table(spark, sf_dir, "documents").withColumn("file_size", F.col("n_chars")))


@query("SELECT count(CASE WHEN user_id % 3 > 0 THEN ts END) AS processed, max(CASE WHEN user_id % 3 > 0 THEN ts END) AS latest, count(*) FILTER (user_id % 3 > 0 AND ts::DATE = (SELECT min(ts)::DATE FROM events)) AS processed_on_day FROM events")
def a17_processing(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 3 > 0, F.col("ts")).alias("processed_time"))
    day = table(spark, sf_dir, "events").agg(F.to_date(F.min("ts")).alias("d")).first().d
    return catalog.processing(e, F.lit(day))


@query(f"WITH {_JOBS} SELECT status, count(*) AS jobs FROM j GROUP BY status")
def a19_job_counts(spark, sf_dir):
    return catalog.job_counts(_jobs(spark, sf_dir))


# --- synchronisation ------------------------------------------------------------------------------

_SNAPSHOTS = f"""{SQL_DOCUMENTS},
old AS (SELECT doc_id, path, document_id, n_chars AS file_size, doc_id * 100.0 AS last_modified, checksum FROM d WHERE doc_id % 10 <> 0),
new AS (SELECT doc_id, path, CASE WHEN doc_id % 10 = 2 THEN n_chars + 1 ELSE n_chars END AS file_size, doc_id * 100.0 + CASE WHEN doc_id % 10 = 3 THEN 1.5 WHEN doc_id % 10 = 4 THEN 0.5 ELSE 0 END AS last_modified,
  CASE WHEN doc_id % 10 = 5 THEN 'x' ELSE checksum END AS checksum FROM d WHERE doc_id % 10 <> 1),
ch AS (SELECT path, CASE WHEN old.path IS NULL THEN 'new' WHEN new.path IS NULL THEN 'deleted' WHEN new.file_size <> old.file_size OR abs(new.last_modified - old.last_modified) > 1 OR new.checksum <> old.checksum THEN 'modified' END AS change
  FROM new FULL JOIN old USING (path))"""


def _snapshots(spark, sf_dir):
    d = views.documents(spark, sf_dir)
    k = F.col("doc_id") % 10
    old = d.where(k != 0).select("doc_id", "path", "document_id", F.col("n_chars").alias("file_size"), (F.col("doc_id") * 100.0).alias("last_modified"), "checksum")
    new = d.where(k != 1).select(
        "doc_id", "path", F.when(k == 2, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("file_size"),
        (F.col("doc_id") * 100.0 + F.when(k == 3, 1.5).when(k == 4, 0.5).otherwise(0.0)).alias("last_modified"), F.when(k == 5, "x").otherwise(F.col("checksum")).alias("checksum"),
    )
    return new, old


@query(f"WITH {_SNAPSHOTS} SELECT path, change FROM ch WHERE change IS NOT NULL")
def t1_snapshot_difference(spark, sf_dir):
    return sync.changes(*_snapshots(spark, sf_dir))


@query(f"WITH {_SNAPSHOTS} SELECT path FROM ch WHERE change = 'new'")
def j3_new_files(spark, sf_dir):
    return sync.new_files(*_snapshots(spark, sf_dir)).select("path")


@query(f"WITH {_SNAPSHOTS} SELECT path FROM ch WHERE change = 'deleted'")
def j4_deleted_files(spark, sf_dir):
    return sync.deleted_files(*_snapshots(spark, sf_dir)).select("path")


@query(f"WITH {_SNAPSHOTS} SELECT path FROM ch WHERE change = 'modified'")
def j5_modified_files(spark, sf_dir):
    return sync.modified_files(*_snapshots(spark, sf_dir)).select("path")


@query(
    f"""WITH {_SNAPSHOTS}
SELECT new.path, NOT (old.path IS NOT NULL AND new.file_size = old.file_size AND new.last_modified = old.last_modified AND old.doc_id % 4 <> 0) AS suspect,
  CASE WHEN new.file_size = old.file_size AND new.last_modified = old.last_modified AND old.doc_id % 4 <> 0 THEN old.checksum END AS checksum
FROM new LEFT JOIN old USING (path)"""
)
def j5_suspects(spark, sf_dir):
    """Files that must be read to tell whether they changed, from the listing alone; a fourth was written just before it was seen."""
    new, old = _snapshots(spark, sf_dir)
    seen = old.withColumn("seen_at", F.col("last_modified") + F.when(F.col("doc_id") % 4 == 0, 1.0).otherwise(60.0))
    return sync.trusted(files.listed(new), seen).select("path", F.col("checksum").isNull().alias("suspect"), "checksum")


@query(f"WITH {_SNAPSHOTS} SELECT new.path, document_id FROM new JOIN old USING (path)")
def j6_known_documents(spark, sf_dir):
    new, old = _snapshots(spark, sf_dir)
    return sync.known_documents(new, old).select("path", "document_id")


@query(f"WITH {_SNAPSHOTS} SELECT count(*) FILTER (change = 'new') AS new, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'deleted') AS deleted FROM ch")
def a20_rescan_summary(spark, sf_dir):
    return sync.change_summary(sync.changes(*_snapshots(spark, sf_dir)))


@query(f"WITH {_SNAPSHOTS} SELECT path, checksum, doc_id % 2 = 0 AS processed FROM old")
def a21_index_listing(spark, sf_dir):
    old = _snapshots(spark, sf_dir)[1]
    return catalog.index_listing(old.withColumn("processed_time", F.when(F.col("doc_id") % 2 == 0, F.col("last_modified"))))


@query(f"WITH {SQL_CHUNKS} SELECT DISTINCT chunk_id FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM c WHERE doc_id % 3 = 0)")
def j2_inserted_chunks(spark, sf_dir):
    c = views.chunks(spark, sf_dir)
    return sync.inserted(c, c.where("doc_id % 3 = 0")).select("chunk_id")


@query(f"WITH {SQL_CHUNKS} SELECT chunk_id FROM c WHERE document_id IN (SELECT document_id FROM d WHERE lang = 'es')")
def j7_scope(spark, sf_dir):
    scope = views.documents(spark, sf_dir).where("lang = 'es'").select("document_id")
    return search.in_scope(views.chunks(spark, sf_dir), scope).select("chunk_id")


@query(f"WITH {SQL_DOCUMENTS} SELECT document_id, CASE WHEN doc_id % 4 = 0 THEN 'cache_only' ELSE 'store_only' END AS side FROM d WHERE doc_id % 4 IN (0, 1)")
def j8_reconciliation(spark, sf_dir):
    d = views.documents(spark, sf_dir)
    return sync.reconciliation(d.where("doc_id % 4 <> 0"), d.where("doc_id % 4 <> 1"))


@query(f"WITH {SQL_COLLECTION} SELECT chunk_id, document_id, path, title, n_chars::DOUBLE AS score, length(text) AS chars, 'text' AS search_type FROM c WHERE n_chars > 500")
def j9_enriched(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    hits = d.where("n_chars > 500").select(F.format_string("c%06d", "doc_id").alias("chunk_id"), F.col("n_chars").cast("double").alias("score"))
    out = search.enriched(views.collection(spark, sf_dir), hits, "text", limited=False)
    return out.select("chunk_id", "document_id", "path", "title", "score", F.length("text").alias("chars"), "search_type")


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def j10_first_seen(spark, sf_dir):
    return sync.first_seen(table(spark, sf_dir, "documents"), "source", "doc_id")


@query(f"WITH {SQL_CHUNKS} SELECT chunk_id FROM c WHERE document_id NOT IN (SELECT document_id FROM d WHERE doc_id % 5 = 0)")
def j11_delete_documents(spark, sf_dir):
    gone = views.documents(spark, sf_dir).where("doc_id % 5 = 0").select("document_id")
    return sync.without_documents(views.chunks(spark, sf_dir), gone).select("chunk_id")


@query(f"WITH {_PATHS} SELECT doc_id, NOT (path LIKE '/kb/%' AND path NOT LIKE '/kb/uploads/%' AND doc_id % 2 = 0) AS may_delete FROM p")
def j13_guarded_delete(spark, sf_dir):
    p = _paths(spark, sf_dir)
    return sync.deletable(p, "/kb", p.where("doc_id % 2 = 0")).select("doc_id", "may_delete")


@query(f"WITH {_SNAPSHOTS} SELECT document_id FROM old JOIN ch USING (path) WHERE change IS NULL UNION ALL SELECT 'new_' || doc_id FROM new JOIN ch USING (path) WHERE change IN ('new', 'modified')")
def j11_applied_delta(spark, sf_dir):
    new, old = _snapshots(spark, sf_dir)
    changed = sync.changes(new, old)
    delta = new.join(changed.where("change in ('new', 'modified')"), "path", "left_semi").select(F.concat(F.lit("new_"), F.col("doc_id").cast("string")).alias("chunk_id"))
    stored = old.select("document_id", F.col("document_id").alias("chunk_id"))
    out = sync.applied(stored, delta.select(F.col("chunk_id").alias("document_id"), "chunk_id"), changed, old)
    return out.select("document_id")


@query(f"WITH {SQL_DOCUMENTS} SELECT doc_id FROM d WHERE doc_id % 3 = 0 AND doc_id % 4 <> 0 OR checksum IN (SELECT checksum FROM d WHERE doc_id % 3 = 0 AND doc_id % 4 <> 0)")
def k3_still_valid(spark, sf_dir):
    d = views.documents(spark, sf_dir).select("doc_id", "checksum")
    stored = d.where("doc_id % 3 = 0").withColumn("fingerprint", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(cache.fingerprint({"size": 1000})))
    valid = cache.still_valid(stored, d, {"fingerprint": cache.fingerprint({"size": 1000})})
    return d.join(valid.select("checksum").distinct(), "checksum", "left_semi").select("doc_id")


@query(f"WITH {SQL_DOCUMENTS} SELECT doc_id FROM d WHERE checksum NOT IN (SELECT checksum FROM d WHERE doc_id % 3 = 0)")
def k4_to_process(spark, sf_dir):
    d = views.documents(spark, sf_dir).select("doc_id", "checksum")
    return cache.to_process(d, d.where("doc_id % 3 = 0")).select("doc_id")


@query(f"WITH {SQL_DOCUMENTS} SELECT doc_id FROM d WHERE checksum IN (SELECT checksum FROM d WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0)")
def s19_chunk_cache(spark, sf_dir):
    d = views.documents(spark, sf_dir).select("doc_id", "checksum")
    now = {"parsing": cache.fingerprint({"parser": "a"}), "chunking": cache.fingerprint({"size": 1000})}
    kept = d.where("doc_id % 2 = 0").withColumns({"parsing": F.when(F.col("doc_id") % 3 == 0, "old").otherwise(now["parsing"]), "chunking": F.when(F.col("doc_id") % 5 == 0, "old").otherwise(now["chunking"])})
    return d.join(cache.still_valid(kept, d, now).select("checksum").distinct(), "checksum", "left_semi").select("doc_id")


@query(
    """SELECT * FROM (VALUES ('chunking', 'chunking'), ('chunking', 'embedding'), ('embedding', 'embedding'), ('index', 'index'), ('parsing', 'parsing'), ('parsing', 'chunking'), ('parsing', 'embedding'),
  ('parsing', 'summarizer'), ('summarizer', 'summarizer')) t(changed, again)"""
)
def k3_cascade(spark, sf_dir):
    now = {s: {"setting": 1} for s in cache.STAGES}
    rows = []
    for stage in cache.STAGES:
        stored = {s: cache.fingerprint({"setting": 1 + (s == stage)}) for s in cache.STAGES}
        rows += [(stage, s) for s in sorted(cache.invalidated(cache.changed_stages(now, stored)))]
    return spark.createDataFrame(rows, "changed string, again string")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND event_id % 2 = 0)")
def t6_not_in_flight(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    jobs_ = e.where("event_type = 'purchase'").select("user_id", F.when(F.col("event_id") % 2 == 0, "running").otherwise("completed").alias("status"))
    return E.not_in_flight(e, jobs_, "user_id").select("event_id")


# --- events ---------------------------------------------------------------------------------------


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
  SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS events, max(event_type) FILTER (ts = m) AS event_type FROM (SELECT *, max(ts) OVER (PARTITION BY user_id, n) AS m FROM k) GROUP BY user_id, n"""
)
def t2_debounced(spark, sf_dir):
    return E.debounced(table(spark, sf_dir, "events"), "user_id", 1800)


@query("WITH n AS (SELECT event_id, ts::DATE AS d, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS r FROM events) SELECT event_id, d || '-' || ((r - 1) // 5) AS batch FROM n")
def t3_micro_batches(spark, sf_dir):
    return E.micro_batches(table(spark, sf_dir, "events")).select("event_id", "batch")


@query("SELECT 'f' || event_id AS path, CASE WHEN event_type = 'purchase' THEN 'delete' ELSE 'upsert' END AS action FROM events WHERE event_type = 'purchase' OR (event_type IN ('click', 'view') AND event_id % 2 = 0)")
def t5_dispatched(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "deleted").when(F.col("event_type") == "click", "created").when(F.col("event_type") == "view", "modified").otherwise("other")
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), kind.alias("event_type"), "event_id")
    return E.dispatched(e, e.where("event_id % 2 = 0"))


@query("SELECT user_id AS session_id, event_id AS document_id FROM events WHERE ts + INTERVAL 1 HOUR > (SELECT max(ts) FROM events) - INTERVAL 12 HOUR")
def t7_active_scopes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    scopes = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("document_id"), (F.col("ts") + F.expr("interval 1 hour")).alias("expires_at"))
    now = e.agg((F.max("ts") - F.expr("interval 12 hours")).alias("t")).first().t
    return E.active_scopes(scopes, F.lit(now)).select("session_id", "document_id")


@query("SELECT user_id, date_trunc('minute', ts) AS start, count(*) AS requests, count(*) > 1 AS limited FROM events GROUP BY 1, 2")
def t8_rate_windows(spark, sf_dir):
    return E.rate_windows(table(spark, sf_dir, "events"), "user_id", "1 minute", 1)


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'purchase') AND user_id = 7")
def t9_subscribed(spark, sf_dir):
    return E.subscribed(table(spark, sf_dir, "events"), {"event_type": ["click", "purchase"], "user_id": 7}).select("event_id")


@query("SELECT event_type, (SELECT count(*) FROM events e WHERE e.event_type = k.event_type) AS events FROM (VALUES ('click'), ('view'), ('no such kind')) k(event_type)")
def t10_event_types(spark, sf_dir):
    return E.counts_by_kind(table(spark, sf_dir, "events"), ["click", "view", "no such kind"])


# --- metadata storage -----------------------------------------------------------------------------


@query("SELECT doc_id, lang AS doc_lang, source AS doc_source, CASE WHEN doc_id % 2 = 0 THEN -1 ELSE doc_id::INT END AS stored_page, CASE WHEN doc_id % 2 = 1 THEN doc_id::INT END AS page, lang FROM documents")
def flattened_metadata(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    none = F.create_map().cast("map<string,string>")
    flat = M.flattened(F.create_map(F.lit("document_id"), F.col("doc_id").cast("string")), F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"), none)
    page = M.stored_page(F.when(F.col("doc_id") % 2 == 1, F.col("doc_id")))
    f = d.select("doc_id", flat.alias("m"), page.alias("stored_page"))
    return f.select("doc_id", F.element_at("m", F.lit("doc_lang")).alias("doc_lang"), F.element_at("m", F.lit("doc_source")).alias("doc_source"), "stored_page", M.loaded_page(F.col("stored_page")).alias("page"), F.element_at(M.unflattened(F.col("m"), "doc_"), F.lit("lang")).alias("lang"))


# --- jobs -----------------------------------------------------------------------------------------


def _queue(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    of = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int"))
    return e.select(F.col("event_id").alias("job_id"), F.col("event_id").alias("sequence"), of("HIGH", "NORMAL", "LOW").alias("priority"), of("queued", "running", "completed", "queued", "failed").alias("status"), (F.col("event_id") % 3).cast("int").alias("attempts"))


_QUEUE = """q AS (SELECT event_id AS job_id, event_id AS sequence, event_id % 3 AS p, CASE event_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' WHEN 3 THEN 'queued' ELSE 'failed' END AS status, (event_id % 3)::INT AS attempts FROM events)"""


@query(f"WITH {_QUEUE} SELECT job_id FROM q WHERE status = 'queued' ORDER BY p, sequence LIMIT 50")
def x1_next_jobs(spark, sf_dir):
    return jobs.next_jobs(_queue(spark, sf_dir), 50).select("job_id")


@query(
    f"""WITH {_QUEUE} SELECT job_id, CASE WHEN status <> 'running' THEN status WHEN job_id % 2 = 0 THEN 'completed' WHEN attempts + 1 < 3 THEN 'queued' ELSE 'failed' END AS status,
  attempts + CASE WHEN status = 'running' THEN 1 ELSE 0 END AS attempts FROM q"""
)
def x1_after_run(spark, sf_dir):
    q = _queue(spark, sf_dir)
    return jobs.after_run(q, q.where("status = 'running'").select("job_id", (F.col("job_id") % 2 == 0).alias("success"))).select("job_id", "status", "attempts")


@query("SELECT doc_id, path, added_at FROM (SELECT doc_id, '/kb/' || source || '/' || doc_id || '.md' AS path, make_timestamp((1700000000 + doc_id * 60) * 1000000) AS added_at FROM documents)")
def x4_document_rows(spark, sf_dir):
    return views.documents(spark, sf_dir).select("doc_id", "path", "added_at")
