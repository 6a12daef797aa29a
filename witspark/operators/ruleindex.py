"""Candidate rows of very many detection rules through an index over their predicates.

Compiled rule by rule, every rule is a column that every event evaluates. The index
turns the rules into small tables instead: for each path the values that some
rule wants, and for each event type the stages of that type. An event meets the values
of its own type and paths by a hash lookup per path, and each distinct predicate that
is no equality is evaluated once. A stage is looked at only where its leading equality
holds (or, without one, at every event of its type), and matches if all of its
predicates hold. The plan has one lookup per path and one for the types, however many
rules there are.

The tables are made from the rules, which the driver holds anyway; they are broadcast.

Ordered rules need no row per rule and event: an event goes through the shuffle once
for each list of group paths, with what its predicates came to as a short text, and
`fold_events` steps all rules of its group at once with arrays over the rules.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from witspark.functions.payload import Resolver
from witspark.functions.predicates import _Value, predicate
from witspark.plans.lineage import broadcast_if_small

#: Stages in one word of a mask.
WORD = 62
_STAGE = "array<struct<rule:int, word:int, bit:bigint, rest:array<int>, alone:boolean>>"
_NONE = f"cast(array() as {_STAGE})"


def wanted_values(expected) -> list | None:
    """The literals of an equality or of a list of them; None for any other predicate."""

    literals = expected.get("in") if isinstance(expected, dict) and "in" in expected else [expected]
    if all(isinstance(v, (str, bool, int, float)) for v in literals):
        return literals
    return None


def _key(text, number, flag) -> Column:
    """One text for a value of any kind, equal where the values are; adding 0.0 makes -0.0 plain."""

    return F.coalesce(
        F.concat(F.lit("s"), text), F.concat(F.lit("n"), (number + F.lit(0.0)).cast("string")),
        F.concat(F.lit("b"), flag.cast("string")),
    )


class Index:
    """The rules as tables: what each (type, value of a path) fulfils and which stages it leads."""

    def __init__(self, rules):
        self.ids: dict[tuple[str, str], int] = {}
        self.tests: dict[tuple[str, str], tuple[int, set[str], object]] = {}  # predicates that are no equality
        fulfils, leads = defaultdict(set), defaultdict(list)
        by_type = defaultdict(list)
        for number, rule in enumerate(rules):
            types = Counter(stage.event_type for stage in rule.stages)
            for i, stage in enumerate(rule.stages):
                named, leader = [], None
                for path, expected in stage.where.items():
                    name = (path, json.dumps(expected, sort_keys=True))
                    own = self.ids.setdefault(name, len(self.ids))
                    named.append(own)
                    values = wanted_values(expected)
                    if values is None:
                        self.tests.setdefault(name, (own, set(), expected))[1].add(stage.event_type)
                        continue
                    for value in values:
                        fulfils[path, stage.event_type, _typed(value)].add(own)
                    if leader is None:
                        leader = (path, values)
                entry = (number, i // WORD, 1 << i % WORD, named, types[stage.event_type] == 1)
                if leader is None:
                    by_type[stage.event_type].append(entry)
                else:
                    for key in {_typed(v) for v in leader[1]}:
                        leads[leader[0], stage.event_type, key].append(entry)
        self.fulfils, self.leads, self.by_type = fulfils, leads, by_type
        self.paths = sorted({path for path, _, _ in fulfils})

    def coded(self, df: DataFrame, resolver: Resolver) -> DataFrame:
        """`df` with `__met`, a text of what the event fulfils; rows without a leading predicate go.

        The text has, by path, the place of the met value in `places()`, then the other
        predicates that hold, then the type. It is short, and equal where the matching stages are.
        """

        spark = df.sparkSession
        parts, leading = [], F.col("event_type").isin(sorted(self.by_type)) if self.by_type else F.lit(False)
        for k, (path, own) in enumerate(zip(self.paths, self.places())):
            value = _Value(resolver, path)
            rows = [(kind, *key, place, bool(entries)) for place, (kind, key, _, entries) in enumerate(own)]
            table = spark.createDataFrame(
                rows, f"__t{k} string, text string, number double, flag boolean, __c{k} int, __l{k} boolean"
            )
            key = _key(F.col("text"), F.col("number"), F.col("flag"))
            table = F.broadcast(table.select(f"__t{k}", key.alias(f"__k{k}x"), f"__c{k}", f"__l{k}"))
            df = df.withColumn(f"__k{k}y", _key(value.text, value.number, value.flag))
            same = (F.col("event_type") == F.col(f"__t{k}")) & (F.col(f"__k{k}y") == F.col(f"__k{k}x"))
            df = df.join(table, same, "left").drop(f"__t{k}", f"__k{k}x", f"__k{k}y")
            parts.append(F.coalesce(F.col(f"__c{k}").cast("string"), F.lit("")))
            leading = leading | F.coalesce(f"__l{k}", F.lit(False))
        single = [
            F.when(F.col("event_type").isin(sorted(kinds)) & predicate(resolver, path, expected), F.lit(own))
            for (path, _), (own, kinds, expected) in sorted(self.tests.items())
        ]
        others = F.array_join(F.filter(F.array(*single), lambda i: i.isNotNull()), ",") if single else F.lit("")
        return df.filter(leading).withColumn("__met", F.concat_ws("|", *parts, others, "event_type"))

    def places(self) -> list[list[tuple]]:
        """Per path: (type, value, predicates that it fulfils, stages that it leads), in a fixed order."""

        found = {path: [] for path in self.paths}
        for (path, kind, key), ids in sorted(self.fulfils.items(), key=repr):
            found[path].append((kind, key, sorted(ids), self.leads.get((path, kind, key), [])))
        return [found[path] for path in self.paths]

    def _broadcast(self, spark: SparkSession, rows, schema: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame(rows, schema))

    def found(self, df: DataFrame, resolver: Resolver) -> DataFrame:
        """`df` with `__hits`: (rule, mask words) of each rule with a matching stage; other rows go."""

        spark = df.sparkSession
        holds, stages = [], []
        for k, path in enumerate(self.paths):
            value = _Value(resolver, path)
            rows = [
                (kind, *key, sorted(ids), self.leads.get((own, kind, key), []))
                for (own, kind, key), ids in sorted(self.fulfils.items(), key=repr)
                if own == path
            ]
            table = spark.createDataFrame(
                rows, f"__t string, text string, number double, flag boolean, __f{k} array<int>, __l{k} {_STAGE}"
            )
            key = _key(F.col("text"), F.col("number"), F.col("flag"))
            table = F.broadcast(table.select(F.col("__t").alias(f"__t{k}"), key.alias(f"__k{k}x"), f"__f{k}", f"__l{k}"))
            df = df.withColumn(f"__k{k}y", _key(value.text, value.number, value.flag))
            same = (F.col("event_type") == F.col(f"__t{k}")) & (F.col(f"__k{k}y") == F.col(f"__k{k}x"))
            df = df.join(table, same, "left").drop(f"__t{k}", f"__k{k}x", f"__k{k}y")
            holds.append(F.coalesce(f"__f{k}", F.expr("cast(array() as array<int>)")))
            stages.append(F.coalesce(f"__l{k}", F.expr(_NONE)))
        if self.by_type:
            table = self._broadcast(spark, sorted(self.by_type.items()), f"__t string, __always {_STAGE}")
            df = df.join(table, F.col("event_type") == F.col("__t"), "left").drop("__t")
            stages.append(F.coalesce("__always", F.expr(_NONE)))
        if self.tests:
            single = [
                F.when(F.col("event_type").isin(sorted(kinds)) & predicate(resolver, path, expected), F.lit(own))
                for (path, _), (own, kinds, expected) in sorted(self.tests.items())
            ]
            holds.append(F.filter(F.array(*single), lambda i: i.isNotNull()))
        held = F.concat(*holds) if holds else F.expr("cast(array() as array<int>)")
        df = df.withColumn("__held", held).withColumn("__led", F.concat(*stages))
        df = df.withColumn("__ok", F.expr("filter(__led, s -> forall(s.rest, p -> array_contains(__held, p)))"))
        return df.filter("size(__ok) > 0").drop("__held", "__led")


def _typed(value) -> tuple:
    """(text, number, flag) of a literal, one of them set."""

    if isinstance(value, str):
        return (value, None, None)
    if isinstance(value, bool):
        return (None, None, value)
    return (None, float(value), None)


def indexed_candidates(df: DataFrame, rules, resolver: Resolver, words: int) -> DataFrame:
    """One row per (rule, event) with at least one matching stage; `df` and `resolver` are prepared.

    Group keys and suppression keys are made once per distinct list of paths.
    """

    index = Index(rules)
    lists = sorted({r.group_by for r in rules} | {r.suppression_key for r in rules if r.suppression_key})
    place = {paths: i for i, paths in enumerate(lists)}
    keys = F.array(*[F.to_json(F.array(*[resolver.text(p) for p in paths])) for paths in lists])
    # A stage that alone in its rule wants the type is the rule's only one at an event; the
    # other stages that match are put together by rule, and only these are looked through for it.
    at_word = f"transform(sequence(0, {words - 1}), w -> if(s.word = w, s.bit, 0L))"
    alone = f"transform(filter(__ok, s -> s.alone), s -> struct(s.rule as rule_no, {at_word} as mask))"
    joined = (
        f"transform(sequence(0, {words - 1}), w -> aggregate(filter(__more, s -> s.rule = r and s.word = w),"
        " 0L, (m, s) -> m | s.bit))"
    )
    more = f"transform(array_distinct(transform(__more, s -> s.rule)), r -> struct(r as rule_no, {joined} as mask))"
    found = index.found(df, resolver).withColumn("__more", F.expr("filter(__ok, s -> not s.alone)"))
    hits = found.select(
        "event_id", F.unix_micros("occurred_at").alias("us"), "sequence", keys.alias("keys"),
        F.inline(F.expr(f"concat({alone}, {more})")),
    )
    at = F.col("rule_no") + 1
    group = F.element_at(F.array(*[F.lit(place[r.group_by] + 1) for r in rules]), at)
    quiet = F.element_at(F.array(*[F.lit(place[r.suppression_key] + 1 if r.suppression_key else 0) for r in rules]), at)
    return hits.select(
        "rule_no",
        "mask",
        F.element_at("keys", group).alias("group_key"),
        F.when(quiet > 0, F.try_element_at("keys", F.greatest(quiet, F.lit(1)))).otherwise("").alias("suppression"),
        "us",
        "sequence",
        "event_id",
    )


def indexed_events(df: DataFrame, rules, resolver: Resolver) -> tuple[DataFrame, Index]:
    """One row per event and list of group paths; `df` and `resolver` are prepared.

    Columns: place (of the list), group_key, us, sequence, event_id, again (whether the
    table holds the id more than once), met (see `Index.coded`), quiet (the suppression keys).
    """

    index = Index(rules)
    groups, quiet = key_lists(rules)

    def key(paths):
        return F.to_json(F.array(*[resolver.text(p) for p in paths]))

    repeated = df.groupBy("event_id").agg(F.count(F.lit(1)).alias("__rows")).filter("__rows > 1")
    repeated = repeated.select(F.col("event_id").alias("__id"), F.lit(True).alias("__again"))
    if repeated.isEmpty():
        marked = df.withColumn("__again", F.lit(False))
    else:
        marked = df.join(broadcast_if_small(repeated), F.col("event_id").eqNullSafe(F.col("__id")), "left")
    lists = F.array(*[F.struct(F.lit(i).alias("place"), key(paths).alias("group_key")) for i, paths in enumerate(groups)])
    rows = index.coded(marked, resolver).select(
        F.inline(lists),
        F.unix_micros("occurred_at").alias("us"),
        "sequence",
        "event_id",
        F.coalesce("__again", F.lit(False)).alias("again"),
        F.col("__met").alias("met"),
        (F.array(*[key(paths) for paths in quiet]) if quiet else F.lit(None).cast("array<string>")).alias("quiet"),
    )
    return rows, index


def key_lists(rules) -> tuple[list, list]:
    """The distinct lists of group paths and of suppression paths."""

    return sorted({r.group_by for r in rules}), sorted({r.suppression_key for r in rules if r.suppression_key})


class _Lookup:
    """The stages of each text of `Index.coded`: {place: (rules, masks by word)}."""

    #: Rules in remembered answers; beyond, they are forgotten and found again.
    MOST = 4_000_000

    def __init__(self, places, by_type, groups, words):
        self.places, self.by_type, self.groups, self.words = places, by_type, groups, words
        self.known, self.size = {}, 0

    def __call__(self, text):
        found = self.known.get(text)
        if found is None:
            if self.size > self.MOST:
                self.known, self.size = {}, 0
            found = self.known[text] = self._found(text)
            self.size += 1 + sum(len(rules) for rules, _ in found.values())
        return found

    def _found(self, text):
        *codes, others, kind = text.split("|", len(self.places) + 1)
        held = set(map(int, others.split(","))) if others else set()
        led = list(self.by_type.get(kind, ()))
        for own, code in zip(self.places, codes):
            if code:
                _, _, ids, entries = own[int(code)]
                held.update(ids)
                led += entries
        masks: dict[int, list[int]] = {}
        for rule, word, bit, rest, _ in led:
            if all(p in held for p in rest):
                masks.setdefault(rule, [0] * self.words)[word] |= bit
        by_place = defaultdict(list)
        for rule in sorted(masks):
            by_place[self.groups[rule]].append(rule)
        return {
            place: (np.array(own, np.int64), np.array([masks[r] for r in own], np.int64))
            for place, own in by_place.items()
        }


class _Lanes:
    """Greedy matching of all rules of a group side by side; one group after the other."""

    def __init__(self, stages):
        self.stages = np.array(stages, np.int64)
        self.at = np.zeros(len(stages), np.int64)
        self.picked = np.zeros((len(stages), max(stages)), np.int64)

    def step(self, rules, masks, event):
        """Offer one event to the rules that it matches some stage of; the rules it completes, or None."""

        at = self.at[rules]
        word = masks[:, 0] if masks.shape[1] == 1 else masks[np.arange(len(rules)), at // WORD]
        took = np.flatnonzero((word >> at % WORD) & 1)
        if not took.size:
            return None
        rules, at = rules[took], at[took]
        self.picked[rules, at] = event
        at += 1
        self.at[rules] = at
        done = rules[at == self.stages[rules]]
        if not done.size:
            return None
        self.at[done] = 0
        return done

    def kept(self):
        """Flat places in `picked` that open matches hold."""

        open_ = np.flatnonzero(self.at)
        return open_, np.arange(self.picked.shape[1]) < self.at[open_, None]


#: Finished matches, and events held for open ones, that make a batch of output.
FLUSH_MATCHES, FLUSH_EVENTS = 20_000, 100_000


def fold_events(index: Index, rules, words: int, names):
    """mapInArrow function: match the sorted rows of `indexed_events`, group after group.

    Holds the open matches of one group and the batch of finished ones. Repeated tuples
    of event ids are dropped where the rule says so; only events whose id comes more than
    once can make them, so only tuples of such events are remembered.
    """

    groups, quiet = key_lists(rules)
    stages = [len(r.stages) for r in rules]
    within = [-1 if r.within_seconds is None or len(r.stages) == 1 else round(r.within_seconds * 1e6) for r in rules]
    unique = [r.deduplicate for r in rules]
    silence = [quiet.index(r.suppression_key) if r.suppression_key else -1 for r in rules]
    find = (index.places(), dict(index.by_type), [groups.index(r.group_by) for r in rules], words)

    def run(batches):
        import pyarrow as pa

        lookup, lanes = _Lookup(*find), _Lanes(stages)
        limit, once, keyed = np.array(within), np.array(unique), np.array(silence)
        current, seen = None, set()
        events, matches = [], []  # (us, id, again, quiet) by place; (group key, rules, places, seen)

        def batch():
            own = np.concatenate([m[1] for m in matches])
            picked = np.concatenate([m[2] for m in matches])
            owner = np.repeat(np.arange(len(matches)), [len(m[1]) for m in matches])
            held = np.arange(picked.shape[1]) < lanes.stages[own, None]
            us = np.array([0 if e[0] is None else e[0] for e in events], np.int64)
            timed = np.array([e[0] is not None for e in events])[picked] & held
            low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
            first = np.where(timed, us[picked], high).min(1)
            last = np.where(timed, us[picked], low).max(1)
            untimed = ~timed.any(1)
            # A sequence outside the window is used up all the same.
            good = (limit[own] < 0) | untimed | (last - first <= limit[own])
            again = np.array([e[2] for e in events])[picked]
            for i in np.flatnonzero(good & once[own] & (again | ~held).all(1)):
                name = (own[i], *[events[e][1] for e in picked[i][held[i]]])
                good[i] = name not in matches[owner[i]][3]
                matches[owner[i]][3].add(name)
            own, picked, owner, held = own[good], picked[good], owner[good], held[good]
            sizes = lanes.stages[own]
            ids = pa.array([e[1] for e in events], pa.string()).take(pa.array(picked[held]))
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            silent = [
                "" if place < 0 else events[e][3][place] for place, e in zip(keyed[own].tolist(), picked[:, 0].tolist())
            ]
            columns = [
                pa.array(own, pa.int32()),
                pa.array([m[0] for m in matches], pa.string()).take(pa.array(owner)),
                pa.ListArray.from_arrays(ends, ids),
                pa.array(first[good], pa.int64(), mask=untimed[good]),
                pa.array(last[good], pa.int64(), mask=untimed[good]),
                pa.array(silent, pa.string()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def forget():
            """Leave the events that open matches hold, at new places."""

            open_, held = lanes.kept()
            used, new = np.unique(lanes.picked[open_][held], return_inverse=True)
            rows = lanes.picked[open_]
            rows[held] = new
            lanes.picked[open_] = rows
            events[:] = [events[e] for e in used.tolist()]
            matches.clear()

        count = 0
        for rows in batches:
            columns = [rows.column(i) for i in range(rows.num_columns)]
            met = columns[6].dictionary_encode()
            answers = [lookup(text) for text in met.dictionary.to_pylist()]
            shown = [c.to_pylist() for c in columns[:6]] + [met.indices.to_pylist(), columns[7].to_pylist()]
            for place, key, us, _sequence, event_id, again, code, silent in zip(*shown):
                if current != (place, key):
                    current, seen = (place, key), set()
                    lanes.at[:] = 0
                found = answers[code].get(place)
                if found is None:
                    continue
                done = lanes.step(*found, len(events))
                events.append((us, event_id, again, silent))
                if done is not None:
                    matches.append((key, done, lanes.picked[done], seen))
                    count += len(done)
                if count >= FLUSH_MATCHES or len(events) >= FLUSH_EVENTS:
                    if matches:
                        yield batch()
                    forget()
                    count = 0
        if matches:
            yield batch()

    return run
