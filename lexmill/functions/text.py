"""Text expressions: tokens, counts, title-like lines, truncation. All stay in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and numbers joined by single dots.
TOKEN = r"[\p{L}\p{N}_]+(?:\.?[\p{L}\p{N}_]+)*"
#: The English stop list of the standard analyzer.
STOP_WORDS = (
    "a an and are as at be by can for from have if in is it may not of on or tbd that the this to us we when will with yet you your"
).split()


def tokens(text: Column) -> Column:
    """Lower-case tokens longer than one character that are no stop words, in order."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda x: (F.length(x) > 1) & ~x.isin(STOP_WORDS))


WHITE = " \t\n\r\f\v"


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(WHITE))


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def heading_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?m)^#+\s"))


def link_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\[([^\]]+)\]\(([^)]+)\)"))


def code_block_count(text: Column) -> Column:
    return F.floor(F.regexp_count(text, F.lit(r"(?m)^```")) / 2).cast("int")


def has_meaningful_text(text: Column, least_chars: int = 10, least_words: int = 2) -> Column:
    trimmed = stripped(text)
    return (F.length(trimmed) >= least_chars) & (F.size(F.filter(F.split(trimmed, r"\s+"), lambda x: x != "")) >= least_words)


def plain_title(title: Column) -> Column:
    """A heading without bold, italic, code and link marks."""
    for pattern in (r"\*\*(.+?)\*\*", r"\*(.+?)\*", r"`(.+?)`", r"\[([^\]]+)\]\([^)]+\)"):
        title = F.regexp_replace(title, pattern, "$1")
    return title


def heading_title(text: Column) -> Column:
    """The first level-one heading, null if there is none."""
    return F.nullif(plain_title(stripped(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1))), F.lit(""))


def title_like(line: Column) -> Column:
    """A line that may serve as title: a heading of 6 to 199 characters, or a capitalised mixed-case line with no dot in its first 50."""
    heading = F.regexp_replace(line, r"^[# ]+", "")
    as_heading = line.startswith("#") & (F.length(line) > 1) & F.length(stripped(heading)).between(6, 199)
    as_line = (
        ~line.startswith("#")
        & F.length(line).between(6, 199)
        & (line != F.upper(line))
        & (line != F.lower(line))
        & F.substring(line, 1, 1).rlike(r"\p{Lu}")
        & ~F.contains(F.substring(line, 1, 50), F.lit("."))
    )
    return as_heading | as_line


def inferred_title(text: Column, stem: Column) -> Column:
    """The first title-like line of the first ten, else the file's stem."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 10), stripped)
    first = F.get(F.filter(lines, title_like), F.lit(0))
    return F.coalesce(stripped(F.regexp_replace(first, r"^[# ]+", "")), stem)


#: Fixed value: what follows a text that was cut.
NOTICE = "\n\n[Content truncated due to length...]"


def truncated(text: Column, budget_tokens: int) -> Column:
    """At most four characters a token, cut at the last full stop if it lies in the final fifth, with a notice."""
    most = 4 * budget_tokens
    head = F.substring(text, 1, most)
    last = F.length(head) - F.instr(F.reverse(head), ".")  # 0-based place of the last full stop
    cut = F.when((F.instr(head, ".") > 0) & (last > 0.8 * most), F.substring(head, F.lit(1), last + 1)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit(NOTICE)))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1))


def highlighted(text: Column, terms: list[str], left: str = "<mark>", right: str = "</mark>") -> Column:
    """The text with each occurrence of the terms, in any case, between marks; longer terms first."""
    import re

    kept = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    if not kept:
        return text
    pattern = "(?i)(" + "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", t) for t in kept) + ")"
    return F.regexp_replace(text, pattern, f"{left}$1{right}")


#: How services word the seconds to wait, in the order they are tried.
RETRY_PATTERNS = (
    r"retry after (\d+)",
    r"try again in (\d+)",
    r"wait (\d+) seconds",
    r"rate limit.*?(\d+)\s*seconds?",
    r"retry-after:\s*(\d+)",
)


def retry_after(message: Column) -> Column:
    """Seconds to wait by the first pattern that matches an error message, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.lower(message), p, 1), F.lit("")) for p in RETRY_PATTERNS]).cast("int")


def estimated_cost(characters: Column, price_per_million: float) -> Column:
    return characters / 4 / 1_000_000 * price_per_million
