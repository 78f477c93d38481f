"""The words and terms of `text.tokenize`, cut inside tasks: a different word is cut down to its term once, not wherever it stands.

Spark's regular expressions and Python's may know other versions of Unicode. `alphabet` asks Spark for its letters and digits, so that both find the same words.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .text import STOP_WORDS

KEPT = 500_000
_known: dict[str, Alphabet] = {}


def _ranges(points: list[int]) -> str:
    runs: list[list[int]] = []
    for x in points:
        if runs and runs[-1][1] == x - 1:
            runs[-1][1] = x
        else:
            runs.append([x, x])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


@dataclass(frozen=True)
class Alphabet:
    """Classes of code points as regular expressions: Spark's letters and digits, and where Python's differ ("": nowhere); newer: Spark has some that Python lacks."""

    word: str
    odd: str
    newer: bool


def alphabet(spark: SparkSession) -> Alphabet:
    app = spark.sparkContext.applicationId
    if app not in _known:
        letter = lambda i: F.decode(F.unhex(F.lpad(F.hex(i), 8, "0")), "UTF-32").rlike(r"^[\p{L}\p{N}]$")
        points = spark.range(1, 0x110000).where("id NOT BETWEEN 55296 AND 57344")
        turns = points.where(letter(F.col("id")) != letter(F.col("id") - 1)).select("id").collect()  # where a run begins or ends
        ends = sorted(r[0] for r in turns)
        theirs = {x for a, b in zip(ends[::2], ends[1::2], strict=True) for x in range(a, b)}
        ours = {x for x in range(0x110000) if chr(x).isalnum()}
        odd = sorted(theirs ^ ours)
        _known[app] = Alphabet(f"[{_ranges(sorted(theirs))}]", f"[{_ranges(odd)}]" if odd else "", bool(theirs - ours))
    return _known[app]


def term(word: str) -> str | None:
    """The term of a lower-case word, if it is one."""
    if len(word) < 2 or word in _STOP:
        return None
    if len(word) > 4:
        for end in ("ing", "ed", "es", "s"):
            if word.endswith(end):
                return word[: -len(end)]
    return word


_STOP = frozenset(STOP_WORDS)
_NOTHING, _SEVERAL = object(), object()
_OTHER = {_NOTHING, _SEVERAL}


@dataclass
class Cutter:
    """Cuts lower-case texts; one for each task. made: what stands for a term, made when it is met."""

    letters: Alphabet
    made: Callable[[str], Any] = str
    held: dict[str, Any] = field(default_factory=dict)
    several: dict[str, list] = field(default_factory=dict)

    def __post_init__(self) -> None:
        exact = self.letters.word
        self._exact, self._pieces_exact = re.compile(f"{exact}+"), re.compile(f"{exact}+|[^{exact[1:]}+")
        self._odd = re.compile(self.letters.odd) if self.letters.odd else None
        self._plain, self._pieces = (self._exact, self._pieces_exact) if self.letters.newer else (re.compile(r"[^\W_]+"), re.compile(r"[^\W_]+|[\W_]+"))

    def terms(self, text: str) -> set:
        """The different terms."""
        if len(self.held) > KEPT:
            self.held.clear()
            self.several.clear()
        words = self._plain.findall(text)
        found = set(map(self.held.get, words))
        if None in found:
            for word in words:
                if word not in self.held:
                    parts = [word] if self._odd is None or word.isascii() else self._exact.findall(word)
                    terms = [self.made(t) for t in map(term, parts) if t is not None]
                    self.held[word] = terms[0] if len(terms) == 1 else _SEVERAL if terms else _NOTHING
                    if len(terms) > 1:
                        self.several[word] = terms
            found = set(map(self.held.get, words))
        if _SEVERAL in found:
            for word in words:
                found.update(self.several.get(word, ()))
        return found - _OTHER

    def pieces(self, text: str) -> list[str]:
        """Runs of letters and digits, and of all else."""
        plain = self._odd is None or text.isascii() or not self._odd.search(text)
        return (self._pieces if plain else self._pieces_exact).findall(text)

    def starts(self, piece: str) -> bool:
        """Whether a piece is of letters and digits."""
        return self._exact.match(piece) is not None
