"""Resident sets by session: one fold over events, run as a stream with keyed state or as a batch.

Events have session, event (``prompt``, ``compact``, ``end`` or ``legacy``), ts, event_id, selected (ids of a prompt, in order), budget
(of a compaction, in tokens), offered (ids that a prompt may show as summaries, in order; the column may be missing) and
prompt_key (the column may be missing). A prompt whose key is among the last ``MEMO`` of its session takes the selection and offers
that it had then, whatever the event says, so a repeat need not be routed. A summary is shown again after ``SUMMARY_APART``
prompts, never for a resident. Clocks count prompts.

On a stream the state is kept by `transformWithState`: a map of residents and one of shown summaries, of which an event reads and
writes only the items that it names, and one value for clocks, adaptive lists and memo. A timer ends idle sessions. The batch
twin streams the sorted rows of a partition through the same fold, so its memory is one session's state, however long it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, MutableMapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SLOTS, REFRESH_AFTER, WORKING_SET, SUMMARY_APART, MEMO = 16, 20, 10, 10, 32
EVENTS = "session long, event string, ts timestamp, event_id long, selected array<long>, budget int, offered array<long>, prompt_key string"
TRACE = "session long, event_id long, event string, now int, injected array<long>, deduplicated array<long>, refreshed array<long>, restored array<long>, evicted array<long>, summarized array<long>, recalled boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
POLICIES = ("adaptive", "lru", "lfu", "index")


class AdaptiveLists:
    """Seen once (t1), seen again (t2), and the ghosts of what either evicted (b1, b2); ``p`` is t1's target length.

    By default a ghost list that was hit forgets a victim that entered it in the same step; ``keep_ghosts`` keeps it.
    """

    def __init__(self, held: dict | None = None, slots: int = SLOTS, keep_ghosts: bool = False):
        held = held or {}
        self.t1, self.t2, self.b1, self.b2 = (list(held.get(k, [])) for k in ("t1", "t2", "b1", "b2"))
        self.p, self.slots, self.keep_ghosts = held.get("p", 0), slots, keep_ghosts

    def dump(self) -> dict:
        return {"t1": self.t1, "t2": self.t2, "b1": self.b1, "b2": self.b2, "p": self.p}

    def _make_room(self, ghost_of_t2: bool) -> None:
        over = len(self.t1) > self.p or (ghost_of_t2 and len(self.t1) == self.p)
        source, ghosts = (self.t1, self.b1) if self.t1 and over else (self.t2, self.b2)
        if source:
            ghosts.append(source.pop(0))
            del ghosts[: -self.slots]

    def use(self, item: int) -> None:
        for live in (self.t1, self.t2):
            if item in live:
                live.remove(item)
                self.t2.append(item)
                return
        for ghosts, others, sign in ((self.b1, self.b2, 1), (self.b2, self.b1, -1)):
            if item in ghosts:
                step = max(1, int(len(others) / len(ghosts) + 0.5))
                self.p = min(self.slots, max(0, self.p + sign * step))
                before = [x for x in ghosts if x != item]
                self._make_room(sign < 0)
                ghosts[:] = [x for x in ghosts if x != item] if self.keep_ghosts else before
                self.t2.append(item)
                return
        if len(self.t1) + len(self.t2) >= self.slots:
            self._make_room(False)
        self.t1.append(item)

    def place(self, item: int) -> tuple[int, int]:
        """Sorts frequent before once-seen before unseen, the newest first."""
        for rank, live in enumerate((self.t2, self.t1)):
            if item in live:
                return rank, -live.index(item)
        return 2, 0


class Session:
    """State of one session.

    entries: item -> first use, last use, last injection, hits, insertion; shown: item -> clock of its last summary; both may be
    maps kept elsewhere. memo: prompt key -> selected, offered, the latest used last.
    """

    def __init__(self, held: dict | None = None, policy: str = "adaptive", tokens: Callable[[int], int] | None = None, keep_ghosts: bool = False, entries: MutableMapping | None = None, shown: MutableMapping | None = None):
        held = held or {}
        self.now, self.seq = held.get("now", 0), held.get("seq", 0)
        self.entries = held.get("entries", {}) if entries is None else entries
        self.shown = held.get("shown", {}) if shown is None else shown
        self.lists = AdaptiveLists(held.get("lists"), keep_ghosts=keep_ghosts)
        self.memo = {k: (selected, offered) for k, selected, offered in held.get("memo", [])}
        self.policy, self.tokens = policy, tokens or (lambda item: 1)

    def small(self) -> dict:
        """All but the two maps."""
        return {"now": self.now, "seq": self.seq, "lists": self.lists.dump(), "memo": [(k, *v) for k, v in self.memo.items()]}

    def dump(self) -> dict:
        return self.small() | {"entries": dict(self.entries.items()), "shown": dict(self.shown.items())}

    def restore_order(self) -> list[int]:
        held = dict(self.entries.items())

        def key(item: int) -> tuple:
            _, last, _, hits, seq = held[item]
            own = {"adaptive": (*self.lists.place(item), -last), "lru": (-last,), "lfu": (-hits, -last), "index": ()}[self.policy]
            return (last <= self.now - WORKING_SET, *own, seq)

        return sorted(held, key=key)

    def _remembered(self, key: str | None, selected: list[int], offered: list[int]) -> tuple[list[int], list[int], bool]:
        """The selection and offers of the same prompt before, else these; the key becomes the latest of ``MEMO``."""
        if key is None:
            return selected, offered, False
        found = self.memo.pop(key, None)
        self.memo[key] = found or (selected, offered)
        while len(self.memo) > MEMO:
            del self.memo[next(iter(self.memo))]
        return *self.memo[key], found is not None

    def migrate(self, items: list[int]) -> None:
        """A state that lists only resident ids: all count as used and injected by the first prompt."""
        self.now = max(self.now, 1 if items else 0)
        for item in dict.fromkeys(items):
            self.seq += 1
            self.entries[item] = [1, 1, 1, 1, self.seq]

    def step(self, event: str, selected: list[int] | None, budget: int | None, offered: list[int] | None = None, key: str | None = None) -> dict[str, list[int] | bool]:
        out: dict = {k: [] for k in ("injected", "deduplicated", "refreshed", "restored", "evicted", "summarized")} | {"recalled": False}
        if event == "prompt":
            self.now += 1
            selected, offered, out["recalled"] = self._remembered(key, list(selected or []), list(offered or []))
            for item in dict.fromkeys(selected):
                held = self.entries.get(item)
                if held is None:
                    self.seq += 1
                    held = [self.now, self.now, self.now, 0, self.seq]
                    out["injected"].append(item)
                else:
                    out["deduplicated"].append(item)
                    held[1], held[3] = self.now, held[3] + 1
                    if self.now - held[2] >= REFRESH_AFTER:
                        out["refreshed"].append(item)
                        held[2] = self.now
                self.entries[item] = held
                self.lists.use(item)
            for item in dict.fromkeys(offered):
                if item not in self.entries and self.now - self.shown.get(item, -SUMMARY_APART) >= SUMMARY_APART:
                    self.shown[item] = self.now
                    out["summarized"].append(item)
            if self.now % SUMMARY_APART == 0:  # older ones no longer hold a summary back
                for item in [i for i, at in self.shown.items() if self.now - at >= SUMMARY_APART]:
                    del self.shown[item]
        elif event == "compact":
            used = 0
            for item in self.restore_order():
                cost = self.tokens(item)
                if used < (budget or 0) and used + cost <= (budget or 0):
                    used += cost
                    out["restored"].append(item)
                    held = self.entries[item]
                    self.entries[item] = [held[0], self.now, self.now, *held[3:]]
                else:
                    out["evicted"].append(item)
            for item in out["evicted"]:  # ghosts remember them
                del self.entries[item]
        elif event == "legacy":
            self.migrate(list(selected or []))
            out["injected"] = list(dict.fromkeys(selected or []))
        return out

    def clear(self) -> None:
        self.entries.clear()
        self.shown.clear()
        self.now = self.seq = 0
        self.lists, self.memo = AdaptiveLists(slots=self.lists.slots, keep_ghosts=self.lists.keep_ghosts), {}


def _trace(rows: pd.DataFrame, session: Session) -> list[tuple]:
    out = []
    numbers = lambda x: None if x is None else [int(i) for i in x]
    for r in rows.itertuples(index=False):
        done = session.step(r.event, numbers(r.selected), None if pd.isna(r.budget) else int(r.budget), numbers(r.offered), None if pd.isna(r.prompt_key) else r.prompt_key)
        out.append((r.session, r.event_id, r.event, session.now, *done.values()))
        if r.event == "end":
            session.clear()
    return out


def _events(events: DataFrame) -> DataFrame:
    more = {c: F.col(c) if c in events.columns else F.lit(None) for c in ("offered", "prompt_key")}
    return events.select("session", "event", "ts", "event_id", "selected", "budget", more["offered"].cast("array<long>").alias("offered"), more["prompt_key"].cast("string").alias("prompt_key"))


_NAMES = [c.split()[0] for c in TRACE.split(", ")]


def trace_batch(events: DataFrame, policy: str = "adaptive", tokens: Callable[[int], int] | None = None) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, Session(None, policy, tokens)
        for batch in batches:
            out: list[tuple] = []
            for own, rows in batch.groupby("session", sort=False, dropna=False):
                if own != key:
                    key, state = own, Session(None, policy, tokens)
                out += _trace(rows, state)
            yield pd.DataFrame(out, columns=_NAMES)

    held = _events(events)
    return held.repartition("session").sortWithinPartitions("session", "ts", "event_id").mapInPandas(run, TRACE)


class _Kept(MutableMapping):
    """A MapState of one key column as a mapping; only what is asked for is read."""

    def __init__(self, state, one: bool):
        self.state, self.one = state, one

    def _value(self, row: tuple):
        return row[0] if self.one else list(row)

    def __contains__(self, key: int) -> bool:
        return self.state.containsKey((key,))

    def __getitem__(self, key: int):
        if key not in self:
            raise KeyError(key)
        return self._value(self.state.getValue((key,)))

    def __setitem__(self, key: int, value) -> None:
        self.state.updateValue((key,), (value,) if self.one else tuple(value))

    def __delitem__(self, key: int) -> None:
        self.state.removeKey((key,))

    def __iter__(self) -> Iterator[int]:
        return iter([k[0] for k in self.state.keys()])

    def __len__(self) -> int:
        return sum(1 for _ in self.state.keys())

    def items(self) -> list[tuple]:
        return [(k[0], self._value(v)) for k, v in self.state.iterator()]

    def clear(self) -> None:
        self.state.clear()


class Residents(StatefulProcessor):
    """The fold with its state in the state store. idle_ms: a session without events for that long ends, with an ``end`` row of id -1; ttl_ms: entries that no event wrote for that long are forgotten."""

    def __init__(self, policy: str, tokens: Callable[[int], int] | None, idle_ms: int | None, ttl_ms: int | None):
        self.policy, self.tokens, self.idle_ms, self.ttl_ms = policy, tokens, idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "item long", "first long, last long, injected long, hits long, seq long", self.ttl_ms)
        self.shown = handle.getMapState("shown", "item long", "at long", self.ttl_ms)
        self.rest = handle.getValueState("rest", "now long, seq long, p long, t1 array<long>, t2 array<long>, b1 array<long>, b2 array<long>, memo_keys array<string>, memo_selected array<array<long>>, memo_offered array<array<long>>")

    def _session(self) -> Session:
        held = self.rest.get() if self.rest.exists() else None
        small: dict = {}
        if held:
            now, seq, p, *lists, keys, selected, offered = held
            small = {"now": now, "seq": seq, "lists": dict(zip(("t1", "t2", "b1", "b2"), map(list, lists), strict=True)) | {"p": p}, "memo": [(k, list(a), list(b)) for k, a, b in zip(keys, selected, offered, strict=True)]}
        return Session(small, self.policy, self.tokens, entries=_Kept(self.entries, False), shown=_Kept(self.shown, True))

    def _keep(self, session: Session) -> None:
        lists = session.lists
        self.rest.update((session.now, session.seq, lists.p, lists.t1, lists.t2, lists.b1, lists.b2, [*session.memo], [list(a) for a, _ in session.memo.values()], [list(b) for _, b in session.memo.values()]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        session = self._session()
        out = _trace(pd.concat(list(rows)).sort_values(["ts", "event_id"]), session)
        self._keep(session)
        if self.idle_ms:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=_NAMES)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = self._session().now
        for state in (self.entries, self.shown, self.rest):
            state.clear()
        yield pd.DataFrame([(key[0], -1, "end", now, [], [], [], [], [], [], False)], columns=_NAMES)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        session = self._session()
        session.migrate([int(i) for ids in initialState["ids"] for i in ids])
        self._keep(session)


def trace_stream(events: DataFrame, policy: str = "adaptive", tokens: Callable[[int], int] | None = None, idle_ms: int | None = None, ttl_ms: int | None = None, legacy: DataFrame | None = None) -> DataFrame:
    """The same over a stream. Rows of a micro-batch are sorted by (ts, event_id) in each session.

    idle_ms, ttl_ms: see `Residents`. legacy: sessions that only list resident ids (session, ids), the state that the stream begins
    with. The session's state store provider must be RocksDB (``ROCKSDB``).
    """
    timed = "ProcessingTime" if idle_ms or ttl_ms else "None"
    first = legacy.select("session", "ids").groupBy("session") if legacy is not None else None
    return _events(events).groupBy("session").transformWithStateInPandas(Residents(policy, tokens, idle_ms, ttl_ms), TRACE, "Append", timed, first)


def residents(trace: DataFrame) -> DataFrame:
    """(session, item, since) of what is resident at the end of a trace: the last of in and out events decides."""
    end = trace.where("event = 'end'").groupBy("session").agg(F.max("event_id").alias("ended"))
    moves = trace.select("session", "event_id", "now", F.explode("injected").alias("item"), F.lit(True).alias("inside"))
    moves = moves.unionByName(trace.select("session", "event_id", "now", F.explode("evicted").alias("item"), F.lit(False).alias("inside")))
    last = moves.groupBy("session", "item").agg(F.max(F.struct("event_id", "now", "inside")).alias("m")).where("m.inside")
    held = last.join(end, "session", "left").where(F.col("ended").isNull() | (F.col("m.event_id") > F.col("ended")))
    return held.select("session", "item", F.col("m.now").alias("since"))


def from_legacy(table: DataFrame) -> DataFrame:
    """Sessions that only list resident ids (session, ids) as events for the batch twin: the first of their session."""
    return table.select("session", F.lit("legacy").alias("event"), F.timestamp_seconds(F.lit(0)).alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.col("ids").alias("selected"), F.lit(None).cast("int").alias("budget"))
