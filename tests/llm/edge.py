"""Tables with every odd case: nulls in any column, empty and very long texts, ties, repeats, clashing names."""

from pyspark.sql import functions as F

CLASHES = ["score", "fp", "component_id", "sequence_id", "offset", "task", "nth", "rank", "hash", "id", "kinds", "n_values", "length", "_dropped", "_block", "block", "stripe", "before", "count", "node", "root", "toxic", "order"]
LONG = " ".join(f"word{i % 977} of the long text" for i in range(60_000))
TEXTS = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "a"),
    (5, "two words"),
    (6, LONG),
    (7, "the same text of ten words that is here twice over"),
    (8, "the same text of ten words that is here twice over"),
    (9, "a repeated row with several words in it"),
    (9, "a repeated row with several words in it"),
    (None, "a text without an id but with words"),
    (None, None),
    (10, "\u0000 control ퟿ ünïcödé 日本語 🙂 text <|endoftext|> end"),
    (11, "x" * 200_000),
]


def documents(spark, texts=None, clashes=True):
    df = spark.createDataFrame(TEXTS if texts is None else texts, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit("clash") for c in CLASHES}) if clashes else df


def empty(spark):
    return documents(spark, []).where("false")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
