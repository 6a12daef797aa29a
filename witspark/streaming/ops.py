"""Streaming forms: sources, idempotent ingest, sequence matching, counts, timeouts, export.

Each equals its batch form on input that stays within the watermark. Stateful
operators need the RocksDB state store provider (see `use_rocksdb`).
"""

from __future__ import annotations

import hashlib
import json
from collections import namedtuple
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from witspark.operators.detect import WORD, _Fold, candidates
from witspark.operators.export import by_redaction, export
from witspark.operators.redact import with_redacted

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_journal(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Lines of append-only journal files as they appear: journal_id, line."""

    reader = spark.readStream.format("text").option("lineSep", "\n")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select(
        F.col("_metadata.file_path").alias("journal_id"), F.col("value").alias("line")
    )


_CLAIM = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("us", T.LongType()),
    ]
)
_RECORD = T.StructType(
    [
        T.StructField("us", T.LongType()),
        T.StructField("arrival", T.LongType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("valid", T.BooleanType()),
    ]
)
_OUTCOME = ["idempotency_key", "arrival", "status", "event_id"]


def _plain(value):
    return value.item() if hasattr(value, "item") else value


class _Ingest(StatefulProcessor):
    """Remembers the record that claimed a key, for as long as the horizon.

    A batch's rows of a key come as a stream of frames. Where a claim could be made
    among them, they wait in list state, frame by frame, until the earliest valid one
    is known; so one frame at most is in memory, however often a batch holds a key.
    """

    def __init__(self, horizon_us: int | None):
        self.horizon_us = horizon_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.claim = handle.getValueState("claim", _CLAIM)
        self.arrived = handle.getListState("arrived", _RECORD)

    def _ends(self, claim) -> int | None:
        return None if self.horizon_us is None else claim[2] + self.horizon_us

    def handleInputRows(self, key, rows, timerValues):
        claims = [tuple(self.claim.get())] if self.claim.exists() else []
        known = len(claims)
        if claims and self.horizon_us is None:
            for frame in rows:
                yield self._judged(key, frame.itertuples(index=False), claims)
            return
        names = [f.name for f in _RECORD.fields]
        for frame in rows:
            self.arrived.appendList([tuple(map(_plain, r)) for r in frame[names].itertuples(index=False)])
        # Each pass over the waiting rows finds the next claim: the earliest valid
        # row behind the end of the one before.
        while not claims or self.horizon_us is not None:
            after = self._ends(claims[-1]) if claims else None
            free = (r for r in self.arrived.get() if r[4] and (after is None or r[0] > after))
            first = min(((r[0], r[1], r[3], r[2]) for r in free), default=None)
            if first is None:
                break
            claims.append((first[2], first[3], first[0], first[1]))
        waiting, size = [], 4096
        for row in self.arrived.get():
            waiting.append(_Row(*row))
            if len(waiting) == size:
                yield self._judged(key, waiting, claims)
                waiting = []
        yield self._judged(key, waiting, claims)
        self.arrived.clear()
        if len(claims) > known:
            if known and self.horizon_us is not None:
                self._forget_timers()
            self.claim.update(claims[-1][:3])
            if self.horizon_us is not None:
                self.handle.registerTimer(self._ends(claims[-1]) // 1000 + 1)

    def _forget_timers(self):
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(_plain(timer[0] if isinstance(timer, tuple) else timer))

    def _judged(self, key, rows, claims):
        out = []
        for row in rows:
            place = (row.us, row.arrival)
            # The claim that holds at this row; the one from before the batch holds for late rows too.
            held = None
            for claim in claims:
                if len(claim) == 3 or (claim[2], claim[3]) <= place:
                    held = claim
            if held is not None and self.horizon_us is not None and row.us > self._ends(held):
                held = None
            if held is None:
                out.append((key[0], row.arrival, "failed", None))
            elif len(held) == 4 and (held[2], held[3]) == place:
                out.append((key[0], row.arrival, "imported", held[0]))
            else:
                status = "duplicate" if held[1] == row.fingerprint else "conflict"
                out.append((key[0], row.arrival, status, held[0]))
        return pd.DataFrame(out, columns=_OUTCOME)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.claim.exists():
            at = expiredTimerInfo.getExpiryTimeInMs() * 1000
            if self._ends(self.claim.get()) < at:
                self.claim.clear()
        yield pd.DataFrame(columns=_OUTCOME)

    def close(self) -> None:
        pass


_Row = namedtuple("_Row", ["us", "arrival", "fingerprint", "event_id", "valid"])


def stream_ingest(
    records: DataFrame, horizon: str | None = None, delay: str = "0 seconds", time: str = "occurred_at"
) -> DataFrame:
    """Outcome of each record as it arrives; same rules as the batch import.

    Records: idempotency_key, us (arrival time in microseconds), arrival,
    fingerprint, event_id, valid. With a `horizon` a claim ends that long after its
    record: a later record of the key makes a new claim, and the state goes once the
    watermark over `time` (with `delay`) has passed its end. Without one, claims stay
    for ever, as in the batch form.
    """

    if horizon is not None:
        records = records.withWatermark(time, delay)
    return records.groupBy("idempotency_key").transformWithStateInPandas(
        statefulProcessor=_Ingest(None if horizon is None else _micros(horizon)),
        outputStructType="idempotency_key string, arrival bigint, status string, event_id string",
        outputMode="Append",
        timeMode="None" if horizon is None else "EventTime",
    )


def _micros(duration: str) -> int:
    return int(pd.Timedelta(duration).total_seconds() * 1_000_000)


def stream_distinct(records: DataFrame, horizon: str, time: str = "occurred_at") -> DataFrame:
    """Records without repeats of (key, fingerprint) inside the horizon."""

    return records.withWatermark(time, horizon).dropDuplicatesWithinWatermark(
        ["idempotency_key", "fingerprint"]
    )


_ROW = T.StructType(
    [
        T.StructField("us", T.LongType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("mask", T.ArrayType(T.LongType())),
        T.StructField("suppression", T.StringType()),
    ]
)
_PARTIAL = T.StructType(
    [
        T.StructField("ids", T.ArrayType(T.StringType())),
        T.StructField("times", T.ArrayType(T.LongType())),
        T.StructField("suppression", T.StringType()),
    ]
)


class _ByTime(StatefulProcessor):
    """Holds rows until the watermark has passed them, then hands them on in event order.

    Rows wait in slots of `slot_ms`, each with a timer at its end, so a timer reads
    only the rows that are due. Timers of a key fire in the order of their times.
    """

    row: T.StructType
    columns: list[str]

    def __init__(self, slot_ms: int):
        self.slot_ms = max(1, slot_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        slot, parts = T.StructField("slot", T.LongType()), T.StructField("parts", T.LongType())
        self.parts = handle.getMapState("parts", T.StructType([slot]), T.StructType([parts]))
        part = T.StructType([slot, T.StructField("part", T.LongType())])
        rows = T.StructType([T.StructField("rows", T.ArrayType(self.row))])
        self.waiting = handle.getMapState("waiting", part, rows)

    def rows_of(self, frame: pd.DataFrame) -> list[tuple]:
        """Rows as tuples that begin with their time in microseconds."""

        names = [f.name for f in self.row.fields]
        return list(zip(*[frame[n].tolist() for n in names]))

    def handleInputRows(self, key, rows, timerValues):
        # A slot's rows are only ever added to, part by part, and read once.
        for frame in rows:
            slots: dict[int, list] = {}
            for row in self.rows_of(frame):
                row = tuple(list(map(int, v)) if hasattr(v, "__len__") and not isinstance(v, str) else v for v in row)
                slots.setdefault(row[0] // 1000 // self.slot_ms, []).append(row)
            for slot, found in slots.items():
                part = self.parts.getValue((slot,))[0] if self.parts.containsKey((slot,)) else 0
                if not part:
                    self.handle.registerTimer((slot + 1) * self.slot_ms)
                self.waiting.updateValue((slot, part), (found,))
                self.parts.updateValue((slot,), (part + 1,))
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        end = expiredTimerInfo.getExpiryTimeInMs()
        slot = end // self.slot_ms - 1
        out = []
        if self.parts.containsKey((slot,)):
            rows = []
            for part in range(self.parts.getValue((slot,))[0]):
                rows += [tuple(r) for r in self.waiting.getValue((slot, part))[0]]
                self.waiting.removeKey((slot, part))
            self.parts.removeKey((slot,))
            out = self.handle_due(key, sorted(rows, key=self.order))
        self.expire(end * 1000)
        yield pd.DataFrame(out, columns=self.columns)

    def wake(self, us: int) -> None:
        """A timer at the end of the slot that holds `us`, so that the slot's rows come first."""

        self.handle.registerTimer((us // 1000 // self.slot_ms + 1) * self.slot_ms)

    def expire(self, us: int) -> None:
        """Drop what no row later than `us` needs."""

    def order(self, row):
        return row[:3]

    def handle_due(self, key, rows) -> list[tuple]:
        raise TypeError("a subclass handles the due rows")

    def close(self) -> None:
        pass


def _slot(delay: str) -> int:
    """A quarter of the delay, in milliseconds.

    A slot costs a dozen calls of the state store, whether it holds one row or many, and
    adds at most a quarter to the time that a row waits for the watermark anyway.
    """

    return int(pd.Timedelta(delay).total_seconds() * 1000) // 4


class Plan(NamedTuple):
    """What the streaming matcher needs of a rule; times in microseconds."""

    stages: int
    within_us: int | None
    ordered: bool
    deduplicate: bool
    quiet_us: int | None

    @classmethod
    def of(cls, rule) -> Plan:
        def micros(seconds):
            return None if seconds is None else round(seconds * 1e6)

        return cls(
            len(rule.stages), micros(rule.within_seconds), rule.ordered, rule.deduplicate,
            micros(rule.suppression_seconds),
        )


_LAST = T.StructType([T.StructField("us", T.LongType())])
_TEXT = T.StructType([T.StructField("text", T.StringType())])


class _Group:
    """Matches due rows of one rule and group, then drops repeats and quietens the rest.

    Ordered rules keep the partial match. It does not expire: a late completion uses
    up its events, just as in the batch form. Unordered rules keep the earliest
    `stages` events of each stage until every stage has one that no stage before it
    took; as rows come in event order, a later one cannot change that choice, so the
    match is final and the list goes.

    A suppression key goes when no further match can start within its time. Seen
    tuples of event ids are not held here but asked of `seen`.
    """

    def __init__(self, partial=None, held=(), done=False, quiet=(), last=None, tuples=0):
        self.partial, self.held, self.done = partial or ([], [], None), [tuple(r) for r in held], done
        self.quiet, self.last, self.tuples = dict(quiet), last, tuples

    def packed(self):
        """The state as a tuple for the store, None if a new group has the same."""

        ids, times, suppression = self.partial
        if not (ids or self.held or self.done or self.quiet or self.last is not None):
            return None
        quiet = (list(self.quiet), list(self.quiet.values()))
        return (ids, times, suppression, self.held, self.done, *quiet, self.last, self.tuples)

    @classmethod
    def unpacked(cls, state):
        ids, times, suppression, held, done, names, at, last, tuples = state
        partial = (list(ids), list(times), suppression)
        return cls(partial, [(*r[:3], list(r[3]), r[4]) for r in held], done, zip(names, at), last, tuples)

    def matches(self, plan, rows, seen):
        if not rows:
            return []
        found = self._ordered(plan, rows) if plan.ordered else self._unordered(plan, rows)
        kept = [match for match in found if self._emits(plan, match, seen)]
        if plan.quiet_us is not None:
            # The next match starts at the open one's first event or later than all due rows.
            earliest = min([rows[-1][0], *self.partial[1]])
            self.quiet = {k: at for k, at in self.quiet.items() if earliest - at <= plan.quiet_us}
        return kept

    def _ordered(self, plan, rows):
        fold = _Fold(plan.stages, plan.within_us)
        fold.start(*self.partial)
        found = [fold.step(mask, us, event_id, key) for us, _sequence, event_id, mask, key in rows]
        self.partial = (fold.ids, fold.times, fold.suppression if fold.ids else None)
        return [match for match in found if match is not None]

    def _unordered(self, plan, rows):
        if self.done:
            return []
        places = [sum(_has(r[3], i) for r in self.held) for i in range(plan.stages)]
        for row in rows:
            wanted = [i for i in range(plan.stages) if _has(row[3], i) and places[i] < plan.stages]
            if wanted:
                mask = [0] * len(row[3])
                for i in wanted:
                    places[i] += 1
                    mask[i // WORD] |= 1 << i % WORD
                self.held.append((*row[:3], mask, row[4]))
        taken: list[tuple] = []
        for i in range(plan.stages):
            free = (r for r in self.held if _has(r[3], i) and all(r[2] != t[2] for t in taken))
            first = next(free, None)
            if first is None:
                return []
            taken.append(first)
        self.held, self.done = [], True
        times = [t[0] for t in taken]
        if plan.within_us is not None and plan.stages > 1 and max(times) - min(times) > plan.within_us:
            return []
        return [([t[2] for t in taken], min(times), max(times), taken[0][4])]

    def _emits(self, plan, match, seen):
        ids, first_us, _last_us, suppression = match
        if plan.deduplicate and plan.ordered and not seen(ids):
            return False
        if plan.quiet_us is not None:
            name = suppression or ""
            if name in self.quiet and first_us - self.quiet[name] <= plan.quiet_us:
                return False
            self.quiet[name] = first_us
        return True


_NAME = T.StructType([T.StructField("rule_no", T.IntegerType()), T.StructField("group_key", T.StringType())])
_NUMBER = T.StructType([T.StructField("number", T.LongType())])
_SEEN = T.StructType([*_NAME.fields, *_TEXT.fields])
_PLACE = T.StructType([*_NAME.fields, *_NUMBER.fields])
_IN_SLOT = T.StructType([T.StructField("slot", T.LongType()), *_NUMBER.fields])
_STATE = T.StructType(
    [
        *_PARTIAL.fields,
        T.StructField("held", T.ArrayType(_ROW)),
        T.StructField("done", T.BooleanType()),
        T.StructField("quiet", T.ArrayType(T.StringType())),
        T.StructField("quiet_us", T.ArrayType(T.LongType())),
        T.StructField("last", T.LongType()),
        T.StructField("tuples", T.LongType()),
    ]
)


class _Sequence(_ByTime):
    """Matches the due rows of a bucket of groups, each group by itself (see `_Group`).

    A call of the state store or a frame costs more than the rows of most groups, so
    rows wait by bucket, and a group costs one read and one write for each slot in which
    it has rows. With a horizon a group without a row for that long starts anew, and all
    of its state goes: its tuples are numbered for that, and the groups that may end in
    a slot are listed by it.
    """

    row = T.StructType([*_ROW.fields, *_NAME.fields])

    def __init__(self, plans: list[Plan], slot_ms: int, horizon_us: int | None):
        super().__init__(slot_ms)
        self.plans, self.columns, self.horizon_us = plans, _MATCH_COLUMNS, horizon_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.groups = handle.getMapState("groups", _NAME, _STATE)
        self.seen = handle.getMapState("seen", _SEEN, _LAST)
        self.tuples = handle.getMapState("tuples", _PLACE, _TEXT)
        self.ending = handle.getMapState("ending", _NUMBER, _NUMBER)
        self.ends = handle.getMapState("ends", _IN_SLOT, _NAME)

    def order(self, row):
        return row[5:], row[:3]

    def handle_due(self, key, rows):
        by_group: dict[tuple, list] = {}
        for row in rows:
            by_group.setdefault(row[5:], []).append(row[:5])
        out = []
        for name, own in by_group.items():
            out += [(*name, *match) for match in self._group_due(name, own)]
        return out

    def _group_due(self, name, rows):
        plan, stored = self.plans[name[0]], self.groups.getValue(name)
        group = _Group() if stored is None else _Group.unpacked(stored)
        before = group.last
        out, session = [], []

        def seen(ids):
            digest = hashlib.sha256(json.dumps(list(ids)).encode()).hexdigest()
            if self.seen.containsKey((*name, digest)):
                return False
            self.seen.updateValue((*name, digest), (0,))
            if self.horizon_us is not None:
                self.tuples.updateValue((*name, group.tuples), (digest,))
                group.tuples += 1
            return True

        for row in rows:
            if self.horizon_us is not None and group.last is not None and row[0] - group.last > self.horizon_us:
                out += group.matches(plan, session, seen)
                session = []
                self._forget(name, group)
                group = _Group()
            session.append(row)
            if self.horizon_us is not None:
                group.last = row[0] if group.last is None else max(group.last, row[0])
        out += group.matches(plan, session, seen)
        state = group.packed()
        if state is not None:
            self.groups.updateValue(name, state)
        elif stored is not None:
            self.groups.removeKey(name)
        if group.last is not None and (before is None or self._end(group.last) != self._end(before)):
            slot = self._end(group.last)
            number = self.ending.getValue((slot,))[0] if self.ending.containsKey((slot,)) else 0
            self.ends.updateValue((slot, number), name)
            self.ending.updateValue((slot,), (number + 1,))
            self.wake(group.last + self.horizon_us)
        return out

    def _end(self, last: int) -> int:
        """The slot in which a group ends that has its last row so far at `last`."""

        return (last + self.horizon_us) // 1000 // self.slot_ms

    def expire(self, us):
        slot = us // 1000 // self.slot_ms - 1
        if self.horizon_us is None or not self.ending.containsKey((slot,)):
            return
        for number in range(self.ending.getValue((slot,))[0]):
            name = tuple(self.ends.getValue((slot, number)))
            self.ends.removeKey((slot, number))
            stored = self.groups.getValue(name)
            # A group with a later row is listed by the slot of that one.
            if stored is not None and self._end(stored[-2]) <= slot:
                self.groups.removeKey(name)
                self._forget(name, _Group.unpacked(stored))
        self.ending.removeKey((slot,))

    def _forget(self, name, group):
        """The seen tuples of a group go."""

        for number in range(group.tuples):
            self.seen.removeKey((*name, self.tuples.getValue((*name, number))[0]))
            self.tuples.removeKey((*name, number))


def _has(mask, stage: int) -> bool:
    return bool(mask[stage // WORD] >> stage % WORD & 1)


#: Keys of the streaming matcher: many for its tasks, few for the calls that each of them costs.
BUCKETS = 1024

_MATCH_COLUMNS = ["rule_no", "group_key", "event_ids", "first_us", "last_us", "suppression"]


def stream_sequences(
    events: DataFrame, rules, delay: str, resolver=None, horizon: str | None = None
) -> DataFrame:
    """Matches of ordered and unordered rules over a stream of events with `occurred_at`.

    Rows later than the watermark are dropped; everything else gives the matches of
    the batch form, without repeats and suppressed as the rules say, each emitted
    once the watermark has passed it. With a `horizon` a group's state ends after a
    pause of that length; without one it stays. Groups are dealt over BUCKETS keys, which
    a checkpoint must keep; the due rows of one slot of a bucket are in memory at once.
    """

    hits = candidates(events, rules, resolver)
    timed = hits.withColumn("at", F.timestamp_micros("us")).withWatermark("at", delay)
    bucket = F.pmod(F.xxhash64("rule_no", "group_key"), F.lit(BUCKETS))
    return timed.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Sequence(
            [Plan.of(r) for r in rules], _slot(delay), None if horizon is None else _micros(horizon)
        ),
        outputStructType=(
            "rule_no int, group_key string, event_ids array<string>, first_us bigint,"
            " last_us bigint, suppression string"
        ),
        outputMode="Append",
        timeMode="EventTime",
    )


class _Suppress(_ByTime):
    """Judges matches in event order, whatever order they arrive in."""

    row = T.StructType(
        [T.StructField("first_us", T.LongType()), T.StructField("match_id", T.StringType())]
    )
    columns = ["group_key", "suppression", "match_id", "first_us"]

    def __init__(self, limit_us: int, slot_ms: int):
        super().__init__(slot_ms)
        self.limit_us = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", _LAST)

    def expire(self, us):
        if self.last.exists() and self.last.get()[0] + self.limit_us < us:
            self.last.clear()

    def handle_due(self, key, rows):
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        for first_us, match_id in rows:
            if last is not None and first_us - last <= self.limit_us:
                continue
            last = first_us
            kept.append((key[0], key[1], match_id, first_us))
        if kept:
            self.last.update((last,))
            self.wake(last + self.limit_us)
        return kept


def stream_suppression(matches: DataFrame, seconds: float, delay: str) -> DataFrame:
    """Matches (group_key, suppression, match_id, first_us) that are not suppressed.

    A match is judged once the watermark has passed it; matches that are later
    than the watermark are dropped. The state of a key goes when the watermark has
    passed the suppression time of its last match.
    """

    timed = matches.withColumn("at", F.timestamp_micros("first_us")).withWatermark("at", delay)
    return timed.groupBy("group_key", "suppression").transformWithStateInPandas(
        statefulProcessor=_Suppress(round(seconds * 1e6), _slot(delay)),
        outputStructType="group_key string, suppression string, match_id string, first_us bigint",
        outputMode="Append",
        timeMode="EventTime",
    )


def stream_status_counts(
    events: DataFrame, delay: str, *, size: str = "1 day", slide: str | None = None, gap: str | None = None
) -> DataFrame:
    """Events per status in tumbling, sliding (`slide`) or session (`gap`) windows."""

    timed = events.withWatermark("occurred_at", delay)
    if gap is not None:
        window = F.session_window("occurred_at", gap)
    elif slide is not None:
        window = F.window("occurred_at", size, slide)
    else:
        window = F.window("occurred_at", size)
    return (
        timed.groupBy(window.alias("w"), "run_id", "verification_status")
        .agg(F.count(F.lit(1)).alias("events"))
        .select("run_id", "verification_status", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
    )


def stream_timeouts(
    actions: DataFrame, observations: DataFrame, seconds: int, delay: str
) -> DataFrame:
    """Acknowledged actions with their observation inside the limit, or a timed_out row.

    actions: event_id, occurred_at. observations: subject_event_id, observed_at.
    """

    left = actions.select("event_id", "occurred_at").withWatermark("occurred_at", delay)
    right = observations.select(
        "subject_event_id", F.col("observed_at").alias("seen_at")
    ).withWatermark("seen_at", delay)
    inside = (
        (F.col("event_id") == F.col("subject_event_id"))
        & (F.col("seen_at") >= F.col("occurred_at"))
        & (F.col("seen_at") <= F.col("occurred_at") + F.expr(f"INTERVAL {seconds} SECONDS"))
    )
    return left.join(right, inside, "left_outer").select(
        "event_id",
        F.when(F.col("seen_at").isNull(), "timed_out").otherwise("observed").alias("outcome"),
    )


def stream_export(events: DataFrame, profile: str, path: str, checkpoint: str):
    """Start writing redacted, mapped micro-batches as text files; failures go to `<path>/failed`.

    A batch overwrites its own folder, so that a retried batch leaves one copy.
    """

    def write(batch: DataFrame, number: int) -> None:
        # Both outputs come from one redaction of the batch.
        safe = with_redacted(batch, "line", "__r").drop("line").persist()
        good, bad = by_redaction(safe)
        export(good, profile).select("record").write.mode("overwrite").text(
            f"{path}/batch={number}"
        )
        bad.write.mode("overwrite").json(f"{path}/failed/batch={number}")
        safe.unpersist()

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_to_files(stream: DataFrame, folder: str) -> None:
    """Run a stream over everything available and write it as Parquet below `folder`."""

    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .option("path", f"{folder}/out")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
