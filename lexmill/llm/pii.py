"""Format-preserving pseudonyms for personal data.

Values are found by pattern and taken only if they are valid: card numbers by their check
digit, IBANs by theirs, US social security and phone numbers by their numbering rules or, with a plus sign, their length, dates
by the calendar, IPv4 addresses by their octets (those of the own host and of everyone stay); mail addresses, access keys and the values of
password/token assignments by their form. Each is mapped by a keyed Feistel permutation on its
own set of values: digits stay digits, separators and check digits stay right, a valid value
maps to a valid one of the same format, equal values map to equal pseudonyms in every
document, and with the key the map can be undone. Values outside the set (after a Feistel
step) are mapped again until they are inside (cycle walking), so it stays one-to-one. All notations
of a day share one permutation, which keeps days after the twelfth of a month among themselves, so that
the pseudonym of 13/02/2001 is read day first again.

The key is a parameter of the operators. ``configured_key`` takes it from the setting ``lexmill.pii.key`` (16
characters or more); where that is unset it draws a random one for the session, so that nobody undoes the result or
links it with another run. Only the query, whose rows are to be the same each time, uses the key printed here.

Null texts stay null and empty ones empty; null ids and repeated rows are treated like any
other; other columns stay as they are; an empty table gives an empty table. Texts are worked
on whole, where they are: there is no shuffle.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import secrets
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, table

#: The key of the query and of tests only: everybody knows it.
DEMONSTRATION_KEY = b"lexmill public demonstration key"
SETTING = "lexmill.pii.key"
ROUNDS = 10


def configured_key(spark: SparkSession) -> bytes:
    """The key in the setting ``lexmill.pii.key``, or else one drawn at random, the same for the rest of the session."""
    given = spark.conf.get(SETTING, None)
    if given is None:
        given = secrets.token_hex(32)
        spark.conf.set(SETTING, given)
    if len(given) < 16:
        raise ValueError(f"{SETTING} needs 16 characters or more")
    return given.encode()


class Feistel:
    """A keyed permutation of range(size): a Feistel network on a * b >= size, walked until inside."""

    def __init__(self, size: int, tweak: str, key: bytes):
        self.size = size
        self.a = math.isqrt(size - 1) + 1 if size > 1 else 1  # the least with a * a >= size
        self.b = -(-size // self.a)
        self.seed = hashlib.blake2b(key=key[:64], digest_size=32, person=b"lexmill.pii")
        self.seed.update(f"{tweak}/{size}".encode())

    def _round(self, k: int, x: int, m: int) -> int:
        h = self.seed.copy()
        h.update(b"%d:%d" % (k, x))
        return int.from_bytes(h.digest(), "big") % m

    def once(self, x: int, back: bool = False) -> int:
        u, v = divmod(x, self.b)  # u < a, v < b
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if k % 2:
                v = (v + sign * self._round(k, u, self.b)) % self.b
            else:
                u = (u + sign * self._round(k, v, self.a)) % self.a
        return u * self.b + v

    def walk(self, x: int, inside: Callable[[int], bool] = lambda y: True, back: bool = False) -> int:
        while True:
            x = self.once(x, back)
            if x < self.size and inside(x):
                return x


def luhn(digits: str) -> int:
    """The check digit that makes digits + it valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def filled(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def only_digits(text: str) -> str:
    return re.sub(r"\D", "", text)


class Kind:
    """A kind of value: its pattern, and the pseudonym of a match, or None if it is not valid."""

    name = ""
    pattern = ""

    def __init__(self, key: bytes):
        self.key = key
        self.networks: dict[tuple, Feistel] = {}

    def network(self, size: int, tweak: str = "") -> Feistel:
        if (size, tweak) not in self.networks:
            if len(self.networks) > 4096:
                self.networks.clear()
            self.networks[size, tweak] = Feistel(size, f"{self.name}/{tweak}", self.key)
        return self.networks[size, tweak]

    def change(self, text: str, back: bool = False) -> str | None:
        raise NotImplementedError


class Card(Kind):
    name = "card"
    pattern = r"(?<![\w.])(?:[3-6]\d{12,15}|[3-6]\d{3}(?:[ -]\d{4}){3})(?![\w]|\.\d)"

    def change(self, text, back=False):
        digits = only_digits(text)
        if luhn(digits[:-1]) != int(digits[-1]):
            return None
        head, body = digits[0], digits[1:-1]
        body = str(self.network(10 ** len(body), head).walk(int(body), back=back)).zfill(len(body))
        return filled(text, head + body + str(luhn(head + body)))


class Iban(Kind):
    name = "iban"
    pattern = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"

    @staticmethod
    def check(country: str, account: str) -> str:
        number = int("".join(str(int(c, 36)) for c in account + country + "00"))
        return f"{98 - number % 97:02d}"

    def change(self, text, back=False):
        plain = text.replace(" ", "")
        country, digits, account = plain[:2], plain[2:4], plain[4:]
        if not 15 <= len(plain) <= 34 or self.check(country, account) != digits:
            return None
        new = mixed(self, account, country, back)
        it = iter(country + self.check(country, new) + new)
        return "".join(c if c == " " else next(it) for c in text)


class Phone(Kind):
    name = "phone"
    pattern = r"(?<![\w.])(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?![\w]|[.-]\d)"

    @staticmethod
    def valid(n: int) -> bool:
        s = f"{n:010d}"
        return s[0] > "1" and s[3] > "1" and s[1:3] != "11"

    def change(self, text, back=False):
        digits = only_digits(text)
        head, body = digits[:-10], int(digits[-10:])
        if not self.valid(body):
            return None
        return filled(text, head + f"{self.network(10**10).walk(body, self.valid, back):010d}")


class International(Kind):
    """A number with a plus sign and 8 to 15 digits in all; the first two digits, which hold the country, stay."""

    name = "phone_int"
    pattern = r"(?<![\w.+])\+[1-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,6}(?![\w]|[.-]\d)"

    def change(self, text, back=False):
        digits = only_digits(text)
        if not 8 <= len(digits) <= 15:
            return None
        head, body = digits[:2], digits[2:]
        return filled(text, head + str(self.network(10 ** len(body), head).walk(int(body), back=back)).zfill(len(body)))


class Ssn(Kind):
    name = "ssn"
    pattern = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"

    @staticmethod
    def valid(n: int) -> bool:
        s = f"{n:09d}"
        return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"

    def change(self, text, back=False):
        n = int(only_digits(text))
        return filled(text, f"{self.network(10**9).walk(n, self.valid, back):09d}") if self.valid(n) else None


class Address(Kind):
    name = "ip"
    pattern = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"

    @staticmethod
    def valid(n: int) -> bool:
        return n not in (0, 0x7F000001, 0xFFFFFFFF)  # no host, this host, every host

    def change(self, text, back=False):
        parts = text.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        n = int.from_bytes(bytes(map(int, parts)), "big")
        if not self.valid(n):
            return None
        return ".".join(map(str, self.network(1 << 32).walk(n, self.valid, back).to_bytes(4, "big")))


class Date(Kind):
    name = "date"
    pattern = r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w]|[./-]\d)"
    FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

    @staticmethod
    def order(text: str) -> tuple[str, ...]:
        if text[4] in "-/":
            return (f"%Y{text[4]}%m{text[4]}%d",)
        return ("%d.%m.%Y",) if "." in text else ("%m/%d/%Y", "%d/%m/%Y")

    def change(self, text, back=False):
        # of the two slash orders a date valid in both is read as month first, and its pseudonym must be too
        size = self.LAST - self.FIRST + 1
        late = lambda n: datetime.date.fromordinal(n + self.FIRST).day > 12
        for form in self.order(text):
            try:
                day = datetime.datetime.strptime(text, form).date().toordinal() - self.FIRST
            except ValueError:
                continue
            if not 0 <= day < size:
                return None
            own = late(day)
            new = datetime.date.fromordinal(self.network(size).walk(day, lambda n: late(n) == own, back) + self.FIRST)
            return new.strftime(form)
        return None


CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
OF = {c: k for k, s in enumerate(CLASSES) for c in s}


def mixed(kind: Kind, text: str, tweak: str = "", back: bool = False, classes=CLASSES) -> str:
    """Digits for digits and letters for letters of the same case; other characters stay."""
    of = OF if classes is CLASSES else {c: k for k, s in enumerate(classes) for c in s}
    size, value = 1, 0
    for c in text:
        if c in of:
            n = len(classes[of[c]])
            size, value = size * n, value * n + classes[of[c]].index(c)
    if size == 1:
        return text
    value = kind.network(size, tweak + "".join(str(of.get(c, c)) for c in text)).walk(value, back=back)
    out = []
    for c in reversed(text):
        if c in of:
            value, k = divmod(value, len(classes[of[c]]))
            c = classes[of[c]][k]
        out.append(c)
    return "".join(reversed(out))


#: Most characters permuted together; a round's hash covers half of them.
BLOCK = 64


def in_blocks(kind: Kind, text: str, tweak: str, back: bool, classes=CLASSES) -> str:
    """mixed() over blocks of like length, each with its place as tweak."""
    n = -(-len(text) // BLOCK)
    if n <= 1:
        return mixed(kind, text, tweak, back, classes)
    edges = [len(text) * k // n for k in range(n + 1)]
    return "".join(mixed(kind, text[x:y], f"{tweak}/{k}/", back, classes) for k, (x, y) in enumerate(zip(edges, edges[1:])))


class Mail(Kind):
    name = "email"
    pattern = r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![\w-])"

    def change(self, text, back=False):
        local, _, domain = text.rpartition("@")
        return mixed(self, local, domain.lower(), back) + "@" + domain


class AccessKey(Kind):
    name = "key"
    pattern = r"(?<!\w)A[KS]IA[A-Z0-9]{16}(?!\w)"

    def change(self, text, back=False):
        return text[:4] + mixed(self, text[4:], text[:4], back, ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",))


class Secret(Kind):
    """A value in quotes up to the closing one, or else up to white space, a quote, comma, semicolon, bracket, & or |, without the sentence's punctuation."""

    name = "secret"
    pattern = (
        r"(?i:\b(?:password|passwd|pwd|token|secret|api_?key)\b[\"']?\s{0,3}[=:]\s{0,3})"
        r"(?:\"[^\s\"]{6,}(?=\")|'[^\s']{6,}(?=')|[\"']?[^\s\"'`,;<>(){}\[\]&|]{5,}[^\s\"'`,;<>(){}\[\]&|.:!?])"
    )
    SPLIT = re.compile(r"([^=:]*[=:]\s*[\"']?)(.*)", re.S)

    def change(self, text, back=False):
        head, value = self.SPLIT.match(text).groups()
        if re.fullmatch(r"[0-9a-f]+", value):
            return head + in_blocks(self, value, "hex", back, ("0123456789abcdef",))
        return head + in_blocks(self, value, "", back) if re.search(r"[0-9]", value) else None


KINDS = (Mail, Secret, AccessKey, Iban, Card, Phone, International, Ssn, Date, Address)
ALL = re.compile("|".join(f"(?P<{k.name}>{k.pattern})" for k in KINDS))
QUICK = re.compile(r"[0-9@]")


class Pseudonyms:
    def __init__(self, key: bytes):
        self.kinds = {k.name: k(key) for k in KINDS}

    def text(self, text: str, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with its values replaced, and (kind, start, end) of each in the text given."""
        if not QUICK.search(text):
            return text, []
        out, at, found, start = [], 0, [], 0
        while m := ALL.search(text, start):
            new = self.kinds[m.lastgroup].change(m[0], back)
            if new is None:  # not valid: what begins inside it may be
                start = self._past(text, m)
                continue
            out += [text[at : m.start()], new]
            found.append((m.lastgroup, m.start(), m.end()))
            at = start = m.end()
        return "".join([*out, text[at:]]) if found else text, found

    @staticmethod
    def _past(text: str, m: re.Match) -> int:
        """Where to look on after a match that is not valid: at the next of its characters that could begin a value."""
        at = m.start() + 1
        while at < m.end() and text[at - 1].isalnum() and text[at].isalnum():
            at += 1
        return at


def pseudonymised(docs: DataFrame, key: bytes) -> DataFrame:
    """documents with text replaced, and the columns n_values (long) and kinds (string, their kinds in order, comma between).

    Columns of those two names in documents are replaced.
    """
    given = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c not in ("n_values", "kinds")])
    given = given.withColumn("text", F.col("text").cast("string"))
    at = given.columns.index("text")

    def run(batches):
        p = Pseudonyms(key)
        for b in batches:
            texts = b.column(at)
            rows = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, "[0-9@]"), False)).to_pylist()
            n, kinds = [0] * b.num_rows, [""] * b.num_rows
            if rows:
                values = texts.to_pylist()
                for k in rows:
                    values[k], found = p.text(values[k])
                    n[k], kinds[k] = len(found), ",".join(x[0] for x in found)
                texts = pa.array(values, pa.string())
            columns = [*b.columns[:at], texts, *b.columns[at + 1 :], pa.array(n, pa.int64()), pa.array(kinds, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "n_values", "kinds"])

    schema = T.StructType([*given.schema.fields, T.StructField("n_values", T.LongType()), T.StructField("kinds", T.StringType())])
    return bounded(given).mapInArrow(run, schema)


def op10_pii(spark, sf_dir):
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMONSTRATION_KEY)
