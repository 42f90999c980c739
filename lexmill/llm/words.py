"""Words of a text as arrays of codes, for window hashes without a Python step per window."""

from __future__ import annotations

import functools
import re

import numpy as np
import xxhash

PLAIN, NUMBER, UNIT = 0, 1, 2
#: Units that may follow a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz pound pounds gram grams kilogram kilograms ton tons "
    "ml l liter liters litre litres gal gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "mph kph kmh hz khz mhz ghz w kw mw v a j kj cal kcal n pa kpa k c f degree degrees percent dollar dollars cent cents euro euros usd eur gbp kb mb gb tb bit bits byte bytes".split()
)
NUMERIC = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*%?")
MIXED = re.compile(r"([-+]?[$€£]?\d[\d.,]*)([^\W\d_]+)")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
PUNCTUATION = ".,;:!?()[]{}\"'"
MOST = 500_000


class Vocabulary:
    """White-space separated words to codes; per code the hash, kind and other marks. Forgets when it grows too large."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.size = 0
        self.hash = np.zeros(1024, dtype=np.uint64)
        self.exact = np.zeros(1024, dtype=np.uint64)  # of the word as it stands; 0: nothing but punctuation
        self.kind = np.zeros(1024, dtype=np.int8)  # -1: no word at all
        self.ends = np.zeros(1024, dtype=bool)
        self.title = np.zeros(1024, dtype=bool)

    def add(self, words: list[str]) -> None:
        """Words that it does not have, each once."""
        hashes, exact, kinds, ends, titles = [], [], [], [], []
        digest = xxhash.xxh64_intdigest
        for word in words:
            if word.isalpha():
                core = stands = word
                end = False
            else:
                last = word[-1]
                core = word[:-1] if last in ".,;:!?" and word[:-1].isalpha() else EDGES.sub("", word)
                stands = word.strip(PUNCTUATION)
                end = last in ".!?:" or word.rstrip("\"')]}")[-1:] in (".", "!", "?", ":")
            kind, hashed, title = -1, 0, False
            low = core.lower()
            if core:
                kind = UNIT if low in UNITS else PLAIN if core.isalpha() else NUMBER if self._number(word, core) else PLAIN
                hashed = digest(low.encode("utf-8", "surrogatepass"), 7)
                title = low != core and core[0].isupper() and (core[1:].islower() or not any(c.isupper() for c in core[1:]))
            stands = stands.lower() if stands != core else low
            # what stands as its core does has a hash made of the core's
            exact.append((hashed * 0x9E3779B97F4A7C15 + 13) & 0xFFFFFFFFFFFFFFFF if stands == low and core else digest(stands.encode("utf-8", "surrogatepass"), 13) if stands else 0)
            hashes.append(hashed)
            kinds.append(kind)
            ends.append(end)
            titles.append(title)
        at, n = self.size, len(words)
        while at + n > len(self.hash):
            for name in ("hash", "exact", "kind", "ends", "title"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        for name, values in (("hash", hashes), ("exact", exact), ("kind", kinds), ("ends", ends), ("title", titles)):
            own = getattr(self, name)
            own[at : at + n] = np.array(values, dtype=own.dtype)
        self.code.update(zip(words, range(at, at + n)))
        self.size += n

    @staticmethod
    def _number(word: str, core: str) -> bool:
        if NUMERIC.fullmatch(word.strip("()[]{}\"'.,;:!?")):
            return True
        mixed = MIXED.fullmatch(core)
        return bool(mixed) and mixed[2].lower() in UNITS

    def codes(self, words: list[str]) -> np.ndarray:
        if self.size > MOST:
            self.clear()
        out = list(map(self.code.get, words))
        if None in out:
            missing = [i for i, c in enumerate(out) if c is None]
            self.add(list(dict.fromkeys([words[i] for i in missing])))
            for i in missing:
                out[i] = self.code[words[i]]
        return np.array(out, dtype=np.int64)


@functools.lru_cache(maxsize=64)
def multipliers(n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"%d" % k, 11) | 1 for k in range(n)], dtype=np.uint64)


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n."""
    return hashes_at(hashes, None, n) if len(hashes) >= n else np.zeros(0, dtype=np.uint64)


def hashes_at(hashes: np.ndarray, begin: np.ndarray | None, n: int) -> np.ndarray:
    """Hashes of the runs of n from these places, or from all."""
    m, size = multipliers(n), len(hashes) - n + 1 if begin is None else len(begin)
    out = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        out += (hashes[k : k + size] if begin is None else hashes[begin + k]) * m[k]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out
