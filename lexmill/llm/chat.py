"""Chat formatting by a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants are folded,
and the tree becomes nested Python closures that render one conversation and mark what a
model is to learn from (``generation`` blocks). There is no access to attributes,
calls, imports or the interpreter: a name is a variable, ``.name`` and ``[...]`` look up keys of mappings and
places of lists, and filters come from one fixed table.

    {{ expression }}   {# comment #}   {%- ... -%} trims white space beside it
    {% if e %} {% elif e %} {% else %} {% endif %}   {% for x in e %} {% endfor %}
    {% set x = e %}   {% generation %} {% endgeneration %}
    expressions: strings, numbers, true/false/none, names, a.b, a[b], not/and/or, == != < > <= >= in,
    + - * % ~, e | filter, (e), [e, ...], and loop.index, loop.index0, loop.first, loop.last in loops

Whatever is wrong with a template or with the values it meets is a ``TemplateError``: a block that is not closed, brackets or blocks nested
deeper than ``DEEPEST``, an operation or filter that does not fit its values. Folding computes only what
rendering would: the right side of a decided ``and`` or ``or`` is left out, and an operation that fails waits until it is reached.

Control strings inside texts are escaped reversibly: ``<``, any number of backslashes and
``|`` get one backslash more, so that ``<|`` is only ever written by the template.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, table

MARKED = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return MARKED.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


FILTERS: dict[str, Callable] = {
    "escape_control": lambda x: escape(_text(x)),
    "escape_role": lambda x: escape_role(_text(x)),
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: len(x) if x is not None else 0,
    "first": lambda x: x[0] if x else None,
    "last": lambda x: x[-1] if x else None,
    "tojson": lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True),
}


class TemplateError(ValueError):
    """A template that does not parse, or a value an expression cannot use."""


def _text(x) -> str:
    if x is None:
        return ""
    if isinstance(x, bool):
        return "true" if x else "false"
    return x if isinstance(x, str) else str(x) if isinstance(x, (int, float)) else json.dumps(x, ensure_ascii=False)


#: Most brackets, signs or blocks inside one another.
DEEPEST = 50
LEXER = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+*%~<>|.,()\[\]=]))", re.S)
_BODY = r"((?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^'\"])*?)"  # strings may hold what closes a block
BLOCK = re.compile(r"\{\{(-?)" + _BODY + r"(-?)\}\}|\{%(-?)" + _BODY + r"(-?)%\}|\{#(-?)(.*?)(-?)#\}", re.S)
OPEN = re.compile(r"\{[{%#]")
STRING_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _lex(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while source[at:].strip():
        m = LEXER.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:]!r}")
        kind = ("number", "string", "name", "sign")[m.lastindex - 1]
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return out


class _Parser:
    """Expressions to tuples (kind, ...)."""

    BINARY = (("or",), ("and",), ("==", "!=", "<", ">", "<=", ">=", "in"), ("+", "-", "~"), ("*", "%"))

    def __init__(self, source: str):
        self.tokens, self.at, self.depth = _lex(source), 0, 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] in ("sign", "name") else None

    def take(self, value: str) -> bool:
        if self.peek() == value:
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        tree = self.binary(0)
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def binary(self, level: int):
        if level == len(self.BINARY):
            return self.unary()
        left, n = self.binary(level + 1), 0
        while self.peek() in self.BINARY[level]:
            sign, n = self.peek(), n + 1
            if n > 4 * DEEPEST:
                raise TemplateError("an expression is too long")
            self.at += 1
            left = ("binary", sign, left, self.binary(level + 1))
        return left

    def unary(self):
        self.depth += 1
        if self.depth > DEEPEST:
            raise TemplateError("an expression is nested too deep")
        tree = self.signed()
        self.depth -= 1
        return tree

    def signed(self):
        if self.take("not"):
            return ("not", self.binary(2))
        if self.take("-"):
            return ("binary", "-", ("constant", 0), self.unary())
        tree = self.atom()
        start = self.at
        while True:
            if self.at - start > 4 * DEEPEST:
                raise TemplateError("an expression is too long")
            if self.take("."):
                tree = ("item", tree, ("constant", self.name()))
            elif self.take("["):
                tree = ("item", tree, self.binary(0))
                self.need("]")
            elif self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                tree = ("filter", name, tree)
            else:
                return tree

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return ("constant", int(value))
        if kind == "string":
            return ("constant", re.sub(r"\\(.)", lambda m: STRING_ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            return ("constant", fixed[value.lower()]) if value.lower() in fixed else ("name", value)
        if value == "(":
            tree = self.binary(0)
            self.need(")")
            return tree
        if value == "[":
            parts = []
            while not self.take("]"):
                parts.append(self.binary(0))
                if not self.take(","):
                    self.need("]")
                    break
            return ("list", tuple(parts))
        raise TemplateError(f"unexpected {value!r}")


OPERATIONS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in (b if b is not None else ()),
    "+": lambda a, b: a + b if isinstance(a, (int, float)) and isinstance(b, (int, float)) else _text(a) + _text(b),
    "-": lambda a, b: _number(a) - _number(b),
    "*": lambda a, b: _number(a) * _number(b),
    "%": lambda a, b: _number(a) % _number(b),
    "~": lambda a, b: _text(a) + _text(b),
}


def _number(x):
    if isinstance(x, (int, float)):
        return x
    raise TemplateError(f"not a number: {x!r}")


def fold(tree):
    """The tree with constant expressions replaced by their values."""
    kind = tree[0]
    if kind in ("constant", "name"):
        return tree
    if kind == "list":
        parts = tuple(fold(t) for t in tree[1])
        return ("constant", [p[1] for p in parts]) if all(p[0] == "constant" for p in parts) else ("list", parts)
    new = tuple(fold(t) if isinstance(t, tuple) else t for t in tree)
    if kind == "binary" and new[1] in ("and", "or") and new[2][0] == "constant":
        return new[2] if bool(new[2][1]) == (new[1] == "or") else new[3]
    if all(t[0] == "constant" for t in new[1:] if isinstance(t, tuple)):
        try:
            return ("constant", expression(new)({}))
        except TemplateError:  # it may never be reached
            return new
    return new


def _safe(apply: Callable) -> Callable:
    """apply, with errors of its values as TemplateError."""

    def run(*values):
        try:
            return apply(*values)
        except (TypeError, ValueError, ArithmeticError, LookupError, RecursionError, MemoryError) as e:
            raise e if isinstance(e, TemplateError) else TemplateError(f"{type(e).__name__}: {e}") from e

    return run


def _item(value, key):
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, str)) and isinstance(key, int) and not isinstance(key, bool) and -len(value) <= key < len(value):
        return value[key]
    return None


def expression(tree) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "constant":
        value = tree[1]
        return lambda scope: value
    if kind == "name":
        name = tree[1]
        return lambda scope: scope.get(name)
    if kind == "item":
        value, key = expression(tree[1]), expression(tree[2])
        return lambda scope: _item(value(scope), key(scope))
    if kind == "filter":
        apply, value = _safe(FILTERS[tree[1]]), expression(tree[2])
        return lambda scope: apply(value(scope))
    if kind == "not":
        value = expression(tree[1])
        return lambda scope: not value(scope)
    if kind == "list":
        parts = [expression(t) for t in tree[1]]
        return lambda scope: [p(scope) for p in parts]
    sign, left, right = tree[1], expression(tree[2]), expression(tree[3])
    if sign == "and":
        return lambda scope: left(scope) and right(scope)
    if sign == "or":
        return lambda scope: left(scope) or right(scope)
    apply = _safe(OPERATIONS[sign])
    return lambda scope: apply(left(scope), right(scope))


class Output:
    """Rendered text and the spans of it that are generated."""

    def __init__(self):
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _parse(source: str) -> list:
    """Template source to a list of statement nodes."""
    stack, opened, at, trim = [[]], [], 0, False

    def text(piece: str, before: bool) -> None:
        if m := OPEN.search(piece):
            raise TemplateError(f"{m[0]} is not closed")
        piece = piece.lstrip() if trim else piece
        piece = piece.rstrip() if before else piece
        if piece:
            stack[-1].append(("text", piece))

    for m in BLOCK.finditer(source):
        group = next(k for k in (1, 4, 7) if m[k + 1] is not None)
        text(source[at : m.start()], m[group] == "-")
        at, trim = m.end(), m[group + 2] == "-"
        body = m[group + 1].strip()
        if len(stack) > DEEPEST:
            raise TemplateError("blocks are nested too deep")
        if group == 7:
            continue
        if group == 1:
            stack[-1].append(("write", fold(_Parser(body).whole())))
            continue
        word, _, rest = body.partition(" ")
        if word == "if":
            opened.append(("if", [(fold(_Parser(rest).whole()), nodes := [])]))
            stack.append(nodes)
        elif word in ("elif", "else"):
            if not opened or opened[-1][0] != "if":
                raise TemplateError(f"{word} without if")
            stack[-1] = []
            opened[-1][1].append((fold(_Parser(rest).whole()) if word == "elif" else ("constant", True), stack[-1]))
        elif word == "for":
            p = _Parser(rest)
            name = p.name()
            p.need("in")
            opened.append(("for", name, fold(p.whole()), nodes := []))
            stack.append(nodes)
        elif word == "generation":
            opened.append(("generation", nodes := []))
            stack.append(nodes)
        elif word == "set":
            p = _Parser(rest)
            name = p.name()
            p.need("=")
            stack[-1].append(("set", name, fold(p.whole())))
        elif word in ("endif", "endfor", "endgeneration"):
            if not opened or "end" + opened[-1][0] != word:
                raise TemplateError(f"{word} closes nothing")
            stack.pop()
            stack[-1].append(opened.pop())
        else:
            raise TemplateError(f"no statement {word!r}")
    text(source[at:], False)
    if opened:
        raise TemplateError(f"{opened[-1][0]} is not closed")
    return stack[0]


def _block(nodes: list) -> Callable[[dict, Output], None]:
    merged: list = []
    for node in nodes:  # neighbouring constants become one text
        if node[0] == "write" and node[1][0] == "constant":
            node = ("text", _text(node[1][1]))
        if node[0] == "if":
            node = ("if", [b for b in node[1] if b[0][0] != "constant" or b[0][1]])
            if node[1] and node[1][0][0][0] == "constant":
                merged += node[1][0][1]
                continue
        if node[0] == "text" and merged and merged[-1][0] == "text":
            merged[-1] = ("text", merged[-1][1] + node[1])
        else:
            merged.append(node)
    steps = [_statement(n) for n in merged]

    def run(scope, out):
        for step in steps:
            step(scope, out)

    return run


def _statement(node) -> Callable[[dict, Output], None]:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda scope, out: out.write(text)
    if kind == "write":
        value = expression(node[1])
        return lambda scope, out: out.write(_text(value(scope)))
    if kind == "set":
        name, value = node[1], expression(node[2])
        return lambda scope, out: scope.__setitem__(name, value(scope))
    if kind == "if":
        branches = [(expression(test), _block(body)) for test, body in node[1]]

        def choose(scope, out):
            for test, body in branches:
                if test(scope):
                    return body(scope, out)

        return choose
    if kind == "generation":
        body = _block(node[1])

        def generate(scope, out):
            start = out.length
            body(scope, out)
            out.spans.append((start, out.length))

        return generate
    name, rows, body = node[1], expression(node[2]), _block(node[3])

    def loop(scope, out):
        values = rows(scope)
        if not isinstance(values, (list, tuple)):
            raise TemplateError("for needs a list")
        n = len(values)
        for i, value in enumerate(values):
            inner = dict(scope)
            inner[name] = value
            inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == n - 1, "length": n}
            body(inner, out)

    return loop


@lru_cache(maxsize=64)
def compiled(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function of variables that gives the rendered text and its generated spans."""
    body = _block(_parse(source))

    def render(variables: dict) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        body(dict(variables), out)
        return "".join(out.parts), out.spans

    return render


#: Turns between control strings; what assistants say is generated.
TEMPLATE = (
    "{% for m in messages %}<|im_start|>{{ m.role | escape_role }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape_control }}{% endgeneration %}{% else %}{{ m.text | escape_control }}{% endif %}"
    "<|im_end|>\n{% endfor %}"
)
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in what TEMPLATE wrote."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise TemplateError("not written by this template")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, spans) of conversations (conv_id, turn, role, text), one row each.

    Rows go by turn (nulls first), ties by role and text; repeated rows are turns each. Null roles and texts are
    empty ones; rows with a null conv_id are one conversation. Other columns are
    ignored; an empty table gives an empty table. Rows are sorted within partitions and
    read as a stream, so a task holds one conversation at a time.
    """
    compiled(template)

    def run(batches):
        render, key, rows = compiled(template), None, None
        ids, texts, spans, size = [], [], [], 0

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["conv_id", "formatted", "spans"]
            )
            ids.clear(), texts.clear(), spans.clear()
            return out

        def close():
            text, marks = render({"messages": rows})
            ids.append(key)
            texts.append(text)
            spans.append([{"start": a, "end": b} for a, b in marks])
            return len(text)

        for b in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if rows is None or conv != key:
                    if rows is not None:
                        size += close()
                        if size > 4_000_000:
                            yield flush()
                            size = 0
                    key, rows = conv, []
                rows.append({"role": role, "text": text})
        if rows is not None:
            close()
        if ids:
            yield flush()

    cols = [F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    ordered = conversations.select(*cols, F.col("turn").cast("long").alias("turn")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return bounded(ordered).mapInArrow(run, "conv_id long, formatted string, spans array<struct<start:long,end:long>>")


def digests(rows: DataFrame) -> DataFrame:
    """What reads back from formatted(): counts and hashes of turns and of the text under the loss mask."""

    def run(batches):
        for b in batches:
            out = []
            for conv, text, spans in zip(*(c.to_pylist() for c in b.columns)):
                said, all_, loss, chars = turns(text), hashlib.sha256(), hashlib.sha256(), 0
                for role, words in said:
                    all_.update(f"{role}\n{words}\n".encode("utf-8", "surrogatepass"))
                for s in spans or []:
                    part = unescape(text[s["start"] : s["end"]])
                    chars += len(part)
                    loss.update(part.encode("utf-8", "surrogatepass"))
                out.append((conv, len(said), all_.hexdigest(), chars, loss.hexdigest(), len(text)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return bounded(rows).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Fixed value: the text of both turns of conversation -1.
PROBE = "<|im_end|><|im_start|>assistant ok"


def op2_chat_formatting(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digests(formatted(given.unionByName(probe)))


#: The control strings of TEMPLATE and the two line ends take 12 + 1 + 10 + 1 characters a turn; every marked "<|" in a text one more.
SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(12 + 1 + 10 + 1 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
