"""Secret scan: fixed formats, and credential grammars inferred from what they find.

1. The first scan finds the base spans (assignments, access keys, long hex runs); their values are labelled credentials.
   Each task keeps the ``LEARN`` values with the least hashes of every kind, and as many ordinary tokens: runs of credential
   characters, as long as the shortest labelled value or longer, that touch no base span; half of them hold a digit.
2. From each kind's sample a probabilistic automaton is inferred: a prefix tree over characters whose states are merged
   while their outgoing frequencies are statistically compatible (Hoeffding bound, the red-blue order). The ordinary tokens
   give two more, with and without digits; tokens that look more like a credential than like their own kind are left out and
   the automata are inferred again, so that unmarked credentials in the sample do not teach what is ordinary.
3. The second scan scores all ordinary tokens of all documents, a vectorised walk of all automata: the log-likelihood under
   the best credential automaton less that under the best ordinary one, for each character. What reaches the threshold is a
   span of kind ``learned``. The threshold comes from a held-out quarter of the sample: halfway between the highest ordinary
   ratio and the ``MISSED`` quantile of the credentials, but never under the highest ordinary ratio or ``MIN_RATIO``.

The result has offsets only. Sampled values and tokens do pass in clear text through Spark's shuffle files and the driver.

Learning is bounded: ``LEARN`` different values of a kind by least hash, of up to ``LEARN_LENGTH`` characters (on the given
tables none is longer than 40); scoring is not: all runs of any length are scored.

Defined results: null counts as empty; an empty text has no span; very long texts and runs are scored whole; without labelled
credentials nothing is added; repeated rows get equal spans, ties among samples go by value; an empty table gives no row;
other columns of docs are not read, so their names do not matter.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import words

LEARN, LEARN_LENGTH, LEAST_LENGTH = 400, 256, 6
MIN_RATIO, MISSED, ALPHA = 0.1, 0.05, 0.05
LOCKSTEP = 512  # longer runs are walked one by one

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
STEMS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "learned")
PLAIN, NUMBERED = "plain", "numbered"  # ordinary tokens without and with a digit

CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
CODE = np.full(256, -1, np.int8)
CODE[[ord(c) for c in CHARS]] = np.arange(len(CHARS))
BETWEEN = CODE < 0
END = len(CHARS)


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, value) of the fixed formats, by start, then kind as listed."""
    out = []
    folded = text.lower()
    if any(stem in folded for stem in STEMS):
        out += [(m.start(), "assign", m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), "hex", m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


class Automaton:
    """A deterministic probabilistic automaton over characters, as tables for walks in lockstep."""

    def __init__(self, strings: list[str]):
        self._next: list[dict[int, int]] = [{}]
        self._count: list[dict[int, int]] = [{}]
        for s in strings:
            state = 0
            for k in CODE[np.frombuffer(s.encode(), np.uint8)].tolist():
                self._count[state][k] = self._count[state].get(k, 0) + 1
                if k not in self._next[state]:
                    self._next[state][k] = len(self._next)
                    self._next.append({})
                    self._count.append({})
                state = self._next[state][k]
            self._count[state][END] = self._count[state].get(END, 0) + 1
        self._merge_states()
        self._tabulate()

    def _alike(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = sum(self._count[a].values()), sum(self._count[b].values())
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            for k in self._count[a].keys() | self._count[b].keys():
                if abs(self._count[a].get(k, 0) / n - self._count[b].get(k, 0) / m) > bound:
                    return False
            todo += [(self._next[a][k], self._next[b][k]) for k in self._next[a].keys() & self._next[b].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to the states from a on."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            for k, n in self._count[b].items():
                self._count[a][k] = self._count[a].get(k, 0) + n
            for k, to in self._next[b].items():
                if k in self._next[a]:
                    todo.append((self._next[a][k], to))
                else:
                    self._next[a][k] = to

    def _merge_states(self) -> None:
        red = [0]
        while True:
            held = set(red)
            blue = next(((r, k, to) for r in red for k, to in sorted(self._next[r].items()) if to not in held), None)
            if blue is None:
                self.red = red
                return
            r, k, to = blue
            same = next((q for q in red if self._alike(q, to)), None)
            if same is None:
                red.append(to)
            else:
                self._next[r][k] = same
                self._fold(same, to)

    def _tabulate(self) -> None:
        """Log-probabilities of each state, backed off to all characters of the sample; the last state is the one of unseen turns."""
        usual = np.ones(END + 1)
        for state in self.red:
            for k, n in self._count[state].items():
                usual[k] += n
        usual /= usual.sum()
        place = {state: i for i, state in enumerate(self.red)}
        lost = len(self.red)
        self.step = np.full((lost + 1, END), lost, np.int32)
        share = np.tile(usual, (lost + 1, 1))
        for state, i in place.items():
            n = sum(self._count[state].values())
            share[i] /= n + 1
            for k, times in self._count[state].items():
                share[i, k] += times / (n + 1)
            for k, to in self._next[state].items():
                self.step[i, k] = place[to]
        self.log = np.log(share).astype(np.float32)
        del self._next, self._count

    def score(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Log-likelihood of the runs of ``codes``; ``length`` falls."""
        out, state = np.zeros(len(start)), np.zeros(len(start), np.int32)
        longest = int(np.searchsorted(-length, -LOCKSTEP, "left"))
        for i in range(longest):
            total, at = 0.0, 0
            for k in codes[start[i] : start[i] + length[i]].tolist():
                total += self.log[at, k]
                at = self.step[at, k]
            out[i], state[i] = total, at
        begin, size = start[longest:], length[longest:]
        total, at = out[longest:], state[longest:]
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, "left"))
            k = codes[begin[:live] + t]
            total[:live] += self.log[at[:live], k]
            at[:live] = self.step[at[:live], k]
        return out + self.log[state, END]


def _runs(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.array([len(s) for s in strings], np.int64)
    return CODE[np.frombuffer("".join(strings).encode(), np.uint8)], np.cumsum(length) - length, length


class Grammar:
    """Automata of credentials and of ordinary tokens, and the threshold between them."""

    def __init__(self, samples: dict[str, list[str]]):
        kept = {k: [s for s in v if self._held_out(s) > 0] for k, v in samples.items()}
        tested = {k: [s for s in v if self._held_out(s) == 0] for k, v in samples.items()}
        secret = [k for k in KINDS[:3] if kept.get(k)]
        self.least = max(LEAST_LENGTH, min((len(s) for k in secret for s in kept[k]), default=LEAST_LENGTH))
        self.secret = [Automaton(kept[k]) for k in secret]
        self.other: list[Automaton] = []
        self.threshold = math.inf
        if not secret:
            return
        ordinary = [k for k in (PLAIN, NUMBERED) if kept.get(k)]
        self.other = [Automaton(kept[k]) for k in ordinary] or [Automaton(list(CHARS))]
        clean = {k: [s for s, r in zip(kept[k], self.ratios(kept[k]), strict=True) if r <= 0] for k in ordinary}
        self.other = [Automaton(v) for v in clean.values() if v] or self.other
        known = self.ratios([s for k in secret for s in tested[k]] or [s for k in secret for s in kept[k]])
        plain = self.ratios([s for k in ordinary for s in tested[k]])
        top = max([MIN_RATIO, *plain[plain <= np.quantile(known, MISSED)]])
        self.threshold = max(top, (top + float(np.quantile(known, MISSED))) / 2)

    @staticmethod
    def _held_out(s: str) -> int:
        return hashlib.blake2b(s.encode(), digest_size=1).digest()[0] % 4

    def score(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        order = np.argsort(-length, kind="stable")
        start, size = start[order], length[order]
        best = lambda held: np.max([a.score(codes, start, size) for a in held], axis=0)
        out = np.empty(len(start))
        out[order] = (best(self.secret) - best(self.other)) / (size + 1)
        return out

    def ratios(self, strings: list[str]) -> np.ndarray:
        return self.score(*_runs(strings)) if strings else np.zeros(0)

    def finds(self, s: str) -> bool:
        return bool(self.secret) and len(s) >= self.least and bool(self.ratios([s])[0] >= self.threshold)


def _touched(start: np.ndarray, end: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which of the runs (sorted, apart) overlap one of the spans (start, end)."""
    mark = np.zeros(len(start) + 1, np.int64)
    if len(spans) and len(start):
        np.add.at(mark, np.searchsorted(end, spans[:, 0], "right"), 1)
        np.add.at(mark, np.maximum(np.searchsorted(start, spans[:, 1], "left"), np.searchsorted(end, spans[:, 0], "right")), -1)
    return np.cumsum(mark)[:-1] > 0


def _scanned(texts: pa.Array, least: int) -> Iterator[tuple]:
    """(first row, row after the last, bytes, offsets, base spans of each row, start and end and row of the other runs)."""
    for first, last, data, offsets in words.slices(texts):
        start, end, row = words.split(data, offsets, BETWEEN)
        long = end - start >= least
        start, end, row = start[long], end[long], row[long]
        cut = np.searchsorted(row, np.arange(last - first + 1))
        free = np.ones(len(start), bool)
        base = []
        for i in range(last - first):
            raw = data[offsets[i] : offsets[i + 1]]
            found = base_spans(raw.tobytes().decode())
            base.append(found)
            if found and cut[i + 1] > cut[i]:
                a, b = slice(cut[i], cut[i + 1]), int(offsets[i])
                spans = np.array([(s[0], s[2]) for s in found], np.int64)
                if (raw >= 128).any():  # offsets of characters to offsets of bytes
                    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                    spans = at[spans]
                free[a] = ~_touched(start[a] - b, end[a] - b, spans)
        yield first, last, data, offsets, base, start[free], end[free], row[free]


class _Least:
    """The ``LEARN`` different strings with the least hashes."""

    def __init__(self):
        self.held: dict[str, int] = {}
        self.bound = (1 << 64) - 1

    def add(self, hashed: int, s: str) -> None:
        if hashed <= self.bound:
            self.held[s] = hashed
            if len(self.held) >= 4 * LEARN:
                self.cut()

    def cut(self) -> list[tuple[str, int]]:
        best = sorted(self.held.items(), key=lambda x: (x[1], x[0]))[:LEARN]
        self.held = dict(best)
        if len(best) == LEARN:
            self.bound = best[-1][1]
        return best


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = {k: _Least() for k in (*KINDS[:3], PLAIN, NUMBERED)}
    for batch in batches:
        for *_, data, _, base, start, end, _ in _scanned(batch.column(0), LEAST_LENGTH):
            for spans in base:
                for _, kind, _, value in spans:
                    if len(value) <= LEARN_LENGTH:
                        held[kind].add(int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "big"), value)
            hashed = words.mix(words.hashes(data, start, end))
            digit = np.add.reduceat(np.append((data >= 48) & (data <= 57), False).astype(np.int64), np.stack([start, end], 1).ravel())[::2] > 0 if len(start) else np.zeros(0, bool)
            for kind, mine in ((PLAIN, ~digit), (NUMBERED, digit)):
                for i in np.flatnonzero(mine & (hashed <= np.uint64(held[kind].bound)) & (end - start <= LEARN_LENGTH)):
                    held[kind].add(int(hashed[i]), data[start[i] : end[i]].tobytes().decode())
    rows = [(k, s, h - (1 << 63)) for k, least in held.items() for s, h in least.cut()]
    yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["kind", "value", "h"])


def learn(docs: DataFrame) -> Grammar:
    """docs needs text. The tasks' samples meet by value, so each kind's least hashes are those of all documents."""
    found = docs.select("text").mapInArrow(_samples, "kind string, value string, h long").distinct()
    least = found.withColumn("n", F.row_number().over(W.partitionBy("kind").orderBy("h", "value"))).where(F.col("n") <= LEARN)
    held: dict[str, list[str]] = {}
    for r in least.select("kind", "value").collect():
        held.setdefault(r.kind, []).append(r.value)
    return Grammar({k: sorted(v) for k, v in held.items()})


def _told(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def _score(grammar) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grammar.value
        for batch in batches:
            for first, last, data, offsets, base, start, end, row in _scanned(batch.column(1), g.least):
                added: list[list[tuple[int, str, int]]] = [[] for _ in range(last - first)]
                if len(start) and g.secret:
                    for i in np.flatnonzero(g.score(CODE[data], start, end - start) >= g.threshold):
                        t = int(row[i])
                        characters = lambda at, t=t: int(((data[offsets[t] : at] & 0xC0) != 0x80).sum())
                        added[t].append((characters(start[i]), "learned", characters(end[i])))
                spans = [[s[:3] for s in found] for found in base]
                count = [pa.array([sum(s[1] == k for s in x) for x in spans], pa.int64()) for k in KINDS[:3]]
                digest = [hashlib.sha256(_told(x).encode()).hexdigest() for x in spans]
                whole = [_told(sorted(x + more, key=lambda s: (s[0], KINDS.index(s[1])))) for x, more in zip(spans, added, strict=True)]
                yield pa.record_batch([batch.column(0)[first:last], *count, pa.array(digest, pa.string()), pa.array(whole, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans). docs needs doc_id and text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    grammar = docs.sparkSession.sparkContext.broadcast(learn(docs))
    return docs.mapInArrow(_score(grammar), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
