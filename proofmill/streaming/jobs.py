"""Streaming forms of the vote, the progress, the counters and the stores.

Stateful jobs are processors of transformWithState: value and map state in
RocksDB, ended by event-time timers, so that state doesn't grow with sessions,
uploads or zones that are over. Rows older than the watermark when they come are
dropped; `run.counted` says how many.

No null stops a stream: rows without a time, or without the key of their state,
are left out unless a job says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import batched
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from proofmill.config import DEFAULT, ENGINES, Config
from proofmill.functions import geometry as G
from proofmill.functions import text as T
from proofmill.operators import manifest as M
from proofmill.operators import reports as O

_DAY_MS = 86_400_000


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts)


class _Timed(StatefulProcessor):
    """A processor with one event-time timer for each key, whose time is the last field of its value state."""

    #: Fields of the value state before the timer.
    fields = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"{self.fields}, timer long")

    def held(self) -> tuple | None:
        return self.state.get()

    def due(self, old: tuple | None, timerValues: Any) -> bool:
        """Whether the key's timer has run out, though new rows came before it was called; it isn't called any more then."""
        if old is None or old[-1] > timerValues.getCurrentWatermarkInMs():
            return False
        self.handle.deleteTimer(old[-1])
        return True

    def keep(self, values: tuple, old: tuple | None, timer: int) -> None:
        """Stores values; the key's timer is moved if its time changed."""
        if old is None or old[-1] != timer:
            if old is not None:
                self.handle.deleteTimer(old[-1])
            self.handle.registerTimer(timer)
        self.state.update((*values, timer))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


#: Groups that the keys of a processor are dealt to by hash. A stream keeps the number that it began with.
GROUPS = 2048
_KEY = "key_json"
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


class _Grouped(StatefulProcessor):
    """A processor for groups of keys, each key with a time at which its state ends.

    The states of a group are one value with an array for each field, and one
    event-time timer is set to the first of their times: a group, not a key,
    costs the calls to the state store.
    """

    #: Fields of a key's state before its time, and columns of the results.
    fields = ""
    columns: tuple[str, ...] = ()
    #: Whether a key whose time is over begins anew with rows that come before its timer is called.
    anew = True

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = [field.split(" ") for field in f"keys string, {self.fields}, ends long".split(", ")]
        self.state = handle.getValueState("state", ", ".join(f"{name} array<{kind}>" for name, kind in kinds) + ", timer long")

    def held(self) -> tuple[dict[str, list], int | None]:
        """The state of each key, ending with its time, and the group's timer."""
        old = self.state.get()
        if old is None:
            return {}, None
        *columns, timer = old
        return {key: values for key, *values in zip(*columns)}, timer

    def keep(self, held: dict[str, list], timer: int | None) -> None:
        first = min((values[-1] for values in held.values()), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if held:
            self.state.update((list(held), *map(list, zip(*held.values())), first))
        elif timer is not None:
            self.state.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held, timer = self.held()
        if self.anew:
            yield from self.frames(self.ended(held, now))
        yield from self.frames(self.take(held, rows, now))
        self.keep(held, timer)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held, timer = self.held()
        yield from self.frames(self.ended(held, timerValues.getCurrentWatermarkInMs()))
        self.keep(held, timer)

    def frames(self, rows: Iterable[tuple]) -> Iterator[pd.DataFrame]:
        for found in batched(rows, 4096):
            yield pd.DataFrame(list(found), columns=list(self.columns))

    def ended(self, held: dict[str, list], now: int) -> Iterator[tuple]:
        for k in [k for k, values in held.items() if values[-1] <= now]:
            yield from self.over(k, held.pop(k))

    def take(self, held: dict[str, list], rows: Iterator[pd.DataFrame], now: int) -> Iterator[tuple]:
        """Takes rows into the states of their keys, and gives what follows from them."""
        raise NotImplementedError

    def over(self, key: str, values: list) -> Iterable[tuple]:
        """Results of a key whose time has come."""
        return ()

    def close(self) -> None:
        pass


def _tuples(rows: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    for frame in rows:
        yield from zip(*(frame[c].tolist() for c in (_KEY, *columns)))


def _grouped(rows: DataFrame, keys: list[str], processor: _Grouped, out: str, mode: str) -> DataFrame:
    """The keys and results of a processor over rows, whose keys travel as JSON: nulls and large numbers stay what they are."""
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    group = F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).cast("int")
    dealt = rows.select(group.alias("key_group"), F.to_json(F.struct(*keys), _JSON).alias(_KEY), *(c for c in rows.columns if c not in keys))
    found = dealt.groupBy("key_group").transformWithStateInPandas(processor, f"{_KEY} string, {out}", mode, "EventTime")
    return found.withColumn(_KEY, F.from_json(_KEY, kinds, _JSON)).select(*(F.col(_KEY)[c].alias(c) for c in keys), *found.columns[1:])


#: Before all times and numbers.
_FIRST = -(1 << 63)


class _Progress(_Grouped):
    fields = "done long, passed long, manual long, seen long, at long, seq long, last string"
    columns = (_KEY, "done", "passed", "manual", "last_status")

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def take(self, held: dict[str, list], rows: Iterator[pd.DataFrame], now: int) -> Iterator[tuple]:
        touched = set()
        for key, at, seq, status, judged in _tuples(rows, "at", "seq", "status", "judged"):
            done, passed, manual, seen, *last, _ = held.get(key) or (0, 0, 0, _FIRST, _FIRST, _FIRST, "", 0)
            if judged:
                passed, manual, last = passed + (status == "PASS"), manual + (status == "MANUAL"), max(last, [at, seq, status])
            seen = max(seen, at)
            held[key] = [done + 1, passed, manual, seen, *last, max(seen // 1000, now) + self.idle_ms]
            touched.add(key)
        for key in touched:
            done, passed, manual, _, at, _, last, _ = held[key]
            yield key, done, passed, manual, last if at > _FIRST else None


def progress(events: DataFrame, delay: str = "10 minutes", config: Config = DEFAULT) -> DataFrame:
    """(session_id, done, passed, manual, last_status) of (session_id, ts, seq, status), for update mode.

    last_status is that of the last event by (ts, seq). A null seq comes before
    others of its time; an event with a null status counts, but leaves the last
    status as it is; of events alike in time and number the greater status
    counts. A null session is a session; events without a time are left out. The
    state of a session ends once config.expiry_days of event time have passed
    without an event of it.
    """
    seq = F.coalesce(F.col("seq").cast("long"), F.lit(_FIRST))
    status = F.coalesce(F.col("status").cast("string"), F.lit(""))
    rows = events.where("ts is not null").withWatermark("ts", delay)
    rows = rows.select("session_id", "ts", seq.alias("seq"), status.alias("status"), F.col("status").isNotNull().alias("judged"), _micros(F.col("ts")).alias("at"))
    out = "done long, passed long, manual long, last_status string"
    return _grouped(rows, ["session_id"], _Progress(config.expiry_days * _DAY_MS), out, "Update")


def session_state(events: DataFrame, delay: str = "10 minutes", config: Config = DEFAULT) -> DataFrame:
    """(session_id, status): the last state that a session was in, for update mode. States expire, and nulls count, as in progress."""
    return progress(events, delay, config).select("session_id", F.col("last_status").alias("status"))


class _Expiring(_Grouped):
    fields = "at long, id string"
    columns = (_KEY, "created", "id")
    anew = False

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def take(self, held: dict[str, list], rows: Iterator[pd.DataFrame], now: int) -> Iterator[tuple]:
        found: dict[str, set] = {}
        for key, at, name in _tuples(rows, "at", "id"):
            found.setdefault(key, set()).add((at, name))
        for key, new in found.items():
            versions = sorted(new | ({tuple(held[key][:2])} if key in held else set()))
            for (at, name), (then, _) in zip(versions, versions[1:]):
                if then - at > self.ttl_ms * 1000:
                    yield key, at, name
            at, name = versions[-1]
            # Micro-seconds are rounded up: an entry isn't over before its time.
            held[key] = [at, name, -(-at // 1000) + self.ttl_ms]

    def over(self, key: str, values: list) -> Iterator[tuple]:
        yield key, *values[:2]


def expired_entries(entries: DataFrame, delay: str = "10 minutes", config: Config = DEFAULT) -> DataFrame:
    """(key, id, created, expired): entries of a store (key, ts, id) whose time is over, each emitted once, for append mode.

    An upload or a template is stored under its key; a newer one takes its
    place. One that config.expiry_days have passed without another is expired
    and its state ends. Entries without a key or a time are left out; a null id is
    empty.
    """
    ttl = config.expiry_days * _DAY_MS
    rows = entries.where("ts is not null and key is not null").withWatermark("ts", delay)
    rows = rows.select(F.col("key").cast("string").alias("key"), "ts", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), _micros(F.col("ts")).alias("at"))
    found = _grouped(rows, ["key"], _Expiring(ttl), "created long, id string", "Append")
    created = F.timestamp_micros("created")
    return found.select("key", "id", created.alias("created"), (created + F.expr(f"interval {config.expiry_days} days")).alias("expired"))


def engine_counters(events: DataFrame) -> DataFrame:
    """(month, engine, calls): counters grow with each call of a known engine, for update mode. A calendar month is no window of fixed length, so its name is the key."""
    known = events.where(F.col("engine").isin(*ENGINES) & (F.col("delta") > 0))
    return known.groupBy(G.month_id(F.col("ts")).alias("month"), "engine").agg(F.sum("delta").alias("calls"))


def expired_days(events: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(day, session_id, n): activity of the days that have passed the expiry, each emitted once, for append mode; the state of a day ends with it."""
    by_day = events.withWatermark("ts", f"{config.expiry_days} days").groupBy(F.window("ts", "1 day").alias("w"), "session_id").agg(F.count("*").alias("n"))
    return by_day.select(F.col("w.start").alias("day"), "session_id", "n")


def consume_once(events: DataFrame, keys: list[str], within: str = "60 days") -> DataFrame:
    """The first row of each key within the watermark: each prepared result is used once at most."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def upserts(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key of a micro-batch."""
    return O.latest(batch, keys, order)


def request_batches(batch: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """A micro-batch of requests (session_id, mode, seq) in chunks for the engines."""
    return M.batches(batch, ("session_id", "mode"), F.col("seq"), config=config)


class _Carried(_Grouped):
    """State of a key: the requests that wait for their chunk to be full, fewer than a chunk, and when the first of them came."""

    fields = "opened long, seen long, chunk long, held array<long>"
    columns = (_KEY, "opened", "chunk", "requests")

    def __init__(self, size: int, wait_ms: int) -> None:
        self.size, self.wait_ms = size, wait_ms

    def take(self, held: dict[str, list], rows: Iterator[pd.DataFrame], now: int) -> Iterator[tuple]:
        for key, at, seq, numbered in _tuples(rows, "at", "seq", "numbered"):
            opened, seen, chunk, waiting, _ = held.get(key) or (None, _FIRST, 0, [], 0)
            opened, seen = at if opened is None else min(opened, at), max(seen, at)
            waiting = [*waiting, seq if numbered else None]
            if len(waiting) == self.size:
                yield key, opened, chunk, waiting
                opened, chunk, waiting = None, chunk + 1, []
            held[key] = [opened, seen, chunk, waiting, max(seen // 1000, now) + self.wait_ms]

    def over(self, key: str, values: list) -> Iterator[tuple]:
        opened, _, chunk, waiting, _ = values
        if waiting:
            yield key, opened, chunk, list(waiting)


def carried_batches(requests: DataFrame, wait: str = "10 minutes", delay: str = "10 minutes", lanes: int = 8, config: Config = DEFAULT) -> DataFrame:
    """(session_id, mode, lane, opened, chunk, requests): requests (session_id, mode, seq, ts) in full chunks, for append mode.

    Requests wait in the state, over micro-batches and restarts, until
    config.batch_size of a session and mode are there; what is left once the
    watermark is `wait` past the last of them goes out as a short chunk, and the
    state ends. Each session and mode has `lanes` lanes, taken by turns of seq, so
    that a hot one is no single task's; a lane's chunks are numbered from 0 until
    it ends, opened is the time of a chunk's earliest request. Which requests
    share a chunk follows from when they come. A null session or mode is one of
    its own, a null seq is in lane 0; requests without a time are left out.
    """
    lane = F.coalesce(F.pmod(F.col("seq"), F.lit(lanes)), F.lit(0)).cast("int")
    rows = requests.where("ts is not null").withWatermark("ts", delay)
    seq = F.col("seq").cast("long")
    rows = rows.select("session_id", "mode", lane.alias("lane"), F.coalesce(seq, F.lit(0)).alias("seq"), seq.isNotNull().alias("numbered"), "ts", _micros(F.col("ts")).alias("at"))
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    found = _grouped(rows, ["session_id", "mode", "lane"], _Carried(config.batch_size, wait_ms), "opened long, chunk long, requests array<long>", "Append")
    return found.withColumn("opened", F.timestamp_micros("opened"))


VOTE = "zone_id long, engine string, text string, rule string, status string, reason string, n_readings long, n_valid long"
def decide(readings: list[tuple[str, str, str, bool]]) -> tuple:
    """(engine, text, rule, status, reason) of readings (engine, text, normalised text, failed), as the vote over tables decides."""
    valid = [r for r in readings if not r[3]]
    if not valid:
        return None, None, None, "MANUAL", "all_engines_failed"
    groups: dict[str, list] = {}
    for r in valid:
        groups.setdefault(r[2], []).append(r)
    size, norm = min((-len(g), n) for n, g in groups.items())
    if size <= -2:
        engine, text = min(r[:2] for r in groups[norm])
        return engine, text, "majority_2_of_3" if len(readings) >= 3 else "match_2", "OK", None
    _, text, engine = min((-len(r[2]), r[1], r[0]) for r in valid)
    return engine, text, "no_confidence_fallback", "MANUAL", "no_consensus"


class _Vote(_Timed):
    """Map state: the reading of each engine; value state: whether the zone is decided."""

    fields = "decided boolean"

    def __init__(self, expected: int, wait_ms: int) -> None:
        self.expected, self.wait_ms = expected, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.readings = handle.getMapState("readings", "engine string", "text string, norm string, failed boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        old = self.held()
        if self.due(old, timerValues):
            yield from self.handleExpiredTimer(key, timerValues, None)
            old = self.held()
        newest = timerValues.getCurrentWatermarkInMs()
        decided = bool(old and old[0])
        held = {} if decided else self.all()
        for r in rows:
            newest = max(newest, r.at // 1000 if r.at is not None else newest)
            new = (r.engine, r.text, r.norm, r.failed)
            known = held.get(r.engine)
            # A reading takes the place of a failure; of two readings the lesser text counts, in whatever order they come.
            if known is None or (known[3], known[1]) > (new[3], new[1]):
                held[r.engine] = new
        due = not decided and len(held) >= self.expected
        if due:
            self.readings.clear()
        elif not decided:
            for engine, *rest in held.values():
                self.readings.updateValue((engine,), tuple(rest))
        self.keep((due or decided,), old, newest + self.wait_ms)
        if due:
            yield self.row(key, held)

    def all(self) -> dict[str, tuple]:
        return {k[0]: (k[0], *v) for k, v in self.readings.iterator()} if self.readings.exists() else {}

    def row(self, key: Any, held: dict[str, tuple]) -> Row:
        votes = list(held.values())
        return Row(**dict(zip(VOTE_FIELDS, (key[0], *decide(votes), len(votes), sum(not r[3] for r in votes)), strict=True)))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        decided, timer = self.held()
        held = self.all()
        self.readings.clear()
        if decided:
            self.state.clear()
        else:
            self.keep((True,), None, max(timer, timerValues.getCurrentWatermarkInMs()) + self.wait_ms)
            yield self.row(key, held)


VOTE_FIELDS = [field.split()[0] for field in VOTE.split(", ")]


def streaming_vote(readings: DataFrame, expected: int = len(ENGINES), delay: str = "10 minutes") -> DataFrame:
    """The vote of each zone of (zone_id, engine, text, error, ts), once `expected` engines have read it, or failed to, or the zone has waited `delay` of event time.

    An engine counts once, however often its reading is delivered; a reading
    takes the place of the engine's failure, and of two readings the lesser text
    stays. A decided zone is remembered for another `delay`, in which further
    readings change nothing. Rows without a zone or an engine are left out; a
    reading without a time counts as of now, and a null text is empty.
    """
    rows = readings.where("zone_id is not null and engine is not null").withWatermark("ts", delay)
    rows = rows.select(
        "zone_id", "engine", "ts", F.coalesce("text", F.lit("")).alias("text"), T.normalize("text", "consensus").alias("norm"), F.col("error").isNotNull().alias("failed"), _micros(F.col("ts")).alias("at")
    )
    wait = int(pd.Timedelta(delay).total_seconds() * 1000)
    return rows.groupBy("zone_id").transformWithState(_Vote(expected, wait), VOTE, "Append", "EventTime")
