"""Sequence detection: rules compiled to stage masks, then one ordered fold.

Rows that match no stage of any rule are dropped before the shuffle. The fold
streams each group in event order and holds only the current partial match, so
no group is ever collected. A group with more rows than one task should take is
range-partitioned over several tasks: a first pass describes what each piece
does to every possible entry stage, one task chains those descriptions (one
small row per piece), and a second pass folds each piece from its true entry.
The place of a row (piece and number) is written into it before the first pass,
so both passes agree whatever plan they become part of.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from witspark.functions.payload import Resolver
from witspark.functions.predicates import predicate
from witspark.operators.ordered import in_order
from witspark.operators.ruleindex import WORD, fold_events, indexed_candidates, indexed_events
from witspark.operators.rules import Rule
from witspark.plans.lineage import cut, has_hot_group

MATCH_SCHEMA = (
    "rule_no int, group_key string, event_ids array<string>,"
    " first_us bigint, last_us bigint, suppression string"
)


def group_keys(df: DataFrame, paths, resolver: Resolver | None = None) -> DataFrame:
    """Add `group_key`: one text per path, empty where missing or falsy."""

    resolver = resolver or Resolver()
    return df.withColumn("group_key", F.array(*[resolver.text(p) for p in paths]))


def stage_condition(resolver: Resolver, stage):
    condition = F.col("event_type") == F.lit(stage.event_type)
    for path, expected in stage.where.items():
        condition = condition & predicate(resolver, path, expected)
    return F.coalesce(condition, F.lit(False))


def stage_mask(rule: Rule, resolver: Resolver, words: int = 1):
    """Words of WORD bits; bit i over all words is set where stage i matches the event."""

    mask = [F.lit(0).cast("bigint")] * words
    for i, stage in enumerate(rule.stages):
        bit = F.lit(1 << i % WORD).cast("bigint")
        mask[i // WORD] = mask[i // WORD] + F.when(stage_condition(resolver, stage), bit).otherwise(
            F.lit(0).cast("bigint")
        )
    return F.array(*mask)


def _bit(stage: int):
    return F.col("mask")[stage // WORD].bitwiseAND(F.lit(1 << stage % WORD).cast("bigint")) != 0


#: Stages of all rules from which on the index pays; both ways give the same rows.
INDEXED_STAGES = 64


def _prepared(df: DataFrame, rules, resolver: Resolver):
    """Events of the rules' types with each path looked up once, and a resolver over that."""

    types = sorted({stage.event_type for rule in rules for stage in rule.stages})
    paths = [p for rule in rules for stage in rule.stages for p in stage.where]
    paths += [p for rule in rules for p in rule.group_by + rule.suppression_key]
    return resolver.prepared(df.filter(F.col("event_type").isin(types)), paths)


def _words(rules) -> int:
    return 1 + max((len(rule.stages) - 1) // WORD for rule in rules)


def _indexed(df: DataFrame, rules) -> bool:
    least = int(df.sparkSession.conf.get("witspark.indexedStages", str(INDEXED_STAGES)))
    return sum(len(rule.stages) for rule in rules) >= least


def candidates(df: DataFrame, rules, resolver: Resolver | None = None) -> DataFrame:
    """One row per (rule, event) with at least one matching stage.

    Few rules are columns of one projection; many go through an index over their
    predicates (`ruleindex`), so that neither the plan nor an event's work grows with
    rules that have nothing to do with the event.
    """

    df, resolver = _prepared(df, rules, resolver or Resolver())
    entries = []
    words = _words(rules)
    if _indexed(df, rules):
        return indexed_candidates(df, rules, resolver, words)
    for number, rule in enumerate(rules):
        skey = [resolver.text(p) for p in rule.suppression_key]
        entries.append(
            F.struct(
                F.lit(number).alias("rule_no"),
                stage_mask(rule, resolver, words).alias("mask"),
                F.to_json(F.array(*[resolver.text(p) for p in rule.group_by])).alias("group_key"),
                (F.to_json(F.array(*skey)) if skey else F.lit("")).alias("suppression"),
            )
        )
    hits = df.select(
        "event_id",
        F.unix_micros("occurred_at").alias("us"),
        "sequence",
        F.explode(
            F.filter(F.array(*entries), lambda e: F.exists(e["mask"], lambda w: w != 0))
        ).alias("hit"),
    )
    return hits.select("hit.*", "us", "sequence", "event_id")


class _Fold:
    """Greedy earliest match through the stages; restarts after the last matched event."""

    def __init__(self, stages: int, within_us):
        self.stages, self.within_us = stages, within_us
        self.start()

    def start(self, ids=(), times=(), suppression=None, stage=None):
        self.ids, self.times, self.suppression = list(ids), list(times), suppression
        self.stage = len(self.ids) if stage is None else stage

    def step(self, mask, us, event_id, suppression):
        """Take one event; returns a finished match (ids, first, last, key) or None."""

        if not mask[self.stage // WORD] >> self.stage % WORD & 1:
            return None
        if self.stage == 0:
            self.suppression = suppression
        self.ids.append(event_id)
        self.times.append(us)
        self.stage += 1
        if self.stage < self.stages:
            return None
        first, last = min(self.times), max(self.times)
        done = (self.ids, first, last, self.suppression)
        self.start()
        # A sequence outside the window is used up all the same.
        if self.within_us is not None and len(done[0]) > 1 and last - first > self.within_us:
            return None
        return done


def _rows(batches):
    for batch in batches:
        yield from zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)])


def _emit(rows, size=4096):
    """Arrow batches of finished matches."""

    import pyarrow as pa

    names = ["rule_no", "group_key", "event_ids", "first_us", "last_us", "suppression"]
    types = [pa.int32(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string()]
    buffer = []

    def batch():
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in buffer], type=t) for i, t in enumerate(types)], names=names
        )

    for row in rows:
        buffer.append(row)
        if len(buffer) == size:
            yield batch()
            buffer.clear()
    if buffer:
        yield batch()


def _fold_partitions(plans):
    """mapInArrow function: fold sorted candidate rows, group after group.

    In split groups the first row of a piece carries `entry`: the partial match
    that its group brings along from the pieces before.
    """

    def run(batches):
        def matches():
            current, fold = None, None
            for rule_no, mask, group_key, suppression, us, _sequence, event_id, *entry in _rows(batches):
                if current != (rule_no, group_key):
                    current, fold = (rule_no, group_key), _Fold(*plans[rule_no])
                if entry and entry[0] is not None:
                    fold.start(*json.loads(entry[0]))
                done = fold.step(mask, us, event_id, suppression)
                if done is not None:
                    ids, start, end, key = done
                    yield (rule_no, group_key, ids, start, end, key)

        yield from _emit(matches())

    return run


PIECE_SCHEMA = (
    "piece bigint, first_key string, single boolean, effect string, last_key string, last_state string"
)
ENTRY_SCHEMA = "at bigint, entry string"

#: monotonically_increasing_id holds the partition above this many bits, the row below.
ROW_BITS = 33


def _text_batch(schema, rows):
    import pyarrow as pa

    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=kinds[kind]) for c, (_, kind) in zip(columns, fields)],
        names=[name for name, _ in fields],
    )


def _describe_pieces(plans):
    """mapInArrow function: what each piece does to the group it begins with.

    Every possible entry stage of the first group is folded side by side; what
    the entry brought along stays symbolic (`kept`), new events are listed.
    """

    def run(batches):
        piece = None

        def described():
            effect = [[kept[s], lane.ids, lane.times, lane.suppression] for s, lane in enumerate(lanes)]
            state = None if fold is None else [fold.ids, fold.times, fold.suppression]
            row = (piece, first_key, last_key is None, json.dumps(effect), last_key, json.dumps(state))
            return _text_batch(PIECE_SCHEMA, [row])

        for rule_no, mask, group_key, suppression, us, _sequence, event_id, at in _rows(batches):
            key = json.dumps([rule_no, group_key])
            if at >> ROW_BITS != piece:
                if piece is not None:
                    yield described()
                piece, first_key, last_key, fold = at >> ROW_BITS, key, None, None
                stages = plans[rule_no][0]
                lanes = [_Fold(stages, None) for _ in range(stages)]
                kept = [True] * stages
                for stage, lane in enumerate(lanes):
                    lane.start(stage=stage)
            if key == first_key:
                for stage, lane in enumerate(lanes):
                    if lane.step(mask, us, event_id, suppression) is not None:
                        kept[stage] = False
            else:
                if key != last_key:
                    last_key, fold = key, _Fold(*plans[rule_no])
                fold.step(mask, us, event_id, suppression)
        if piece is not None:
            yield described()

    return run


def _chain_pieces(batches):
    """mapInArrow function over all descriptions in order: entry state by a piece's first row."""

    carry_key, carry = None, ([], [], None)
    for piece, first_key, single, effect, last_key, last_state in _rows(batches):
        state = carry if carry_key == first_key else ([], [], None)
        if state[0]:
            yield _text_batch(ENTRY_SCHEMA, [(piece << ROW_BITS, json.dumps(state))])
        kept, ids, times, suppression = json.loads(effect)[len(state[0])]
        if kept:
            ids, times = state[0] + ids, state[1] + times
            suppression = state[2] if state[0] else suppression
        if single:
            carry_key, carry = first_key, (ids, times, suppression)
        else:
            carry_key, carry = last_key, tuple(json.loads(last_state))


def _may_be_hot(df: DataFrame, rules, resolver: Resolver) -> bool:
    """Whether some group holds too many events of the rules' types for one task.

    Counts groups by their key columns alone, without looking into predicates;
    where this bound holds, the matching rows need no second look.
    """

    types = sorted({stage.event_type for rule in rules for stage in rule.stages})
    typed = df.filter(F.col("event_type").isin(types))
    return any(
        has_hot_group(typed, [resolver.text(p).alias(f"k{i}") for i, p in enumerate(paths)])
        for paths in sorted({rule.group_by for rule in rules})
    )


def _ordered_matches(hits: DataFrame, rules, may_be_hot: bool) -> DataFrame:
    plans = [
        (len(r.stages), None if r.within_seconds is None else round(r.within_seconds * 1e6))
        for r in rules
    ]
    keys, order = ["rule_no", "group_key"], ["us", "sequence", "event_id"]
    if not (may_be_hot and has_hot_group(hits, keys)):
        spread = hits.repartition(*keys).sortWithinPartitions(*keys, *order)
        return spread.mapInArrow(_fold_partitions(plans), MATCH_SCHEMA)
    pieces = cut(
        hits.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("at", F.monotonically_increasing_id())
    )
    # One row per piece, each with at most (stages x stages) event ids; the chain
    # over the pieces is the only step in one task.
    described = pieces.mapInArrow(_describe_pieces(plans), PIECE_SCHEMA)
    entries = described.repartition(1).sortWithinPartitions("piece").mapInArrow(_chain_pieces, ENTRY_SCHEMA)
    # Only the first row of a piece meets an entry; the broadcast side has at most
    # one row per piece, and the order of the pieces' rows stays.
    entered = pieces.join(F.broadcast(entries), "at", "left").select(*hits.columns, "entry")
    return entered.mapInArrow(_fold_partitions(plans), MATCH_SCHEMA)


def _indexed_matches(df: DataFrame, rules, resolver: Resolver) -> DataFrame:
    """Matches of many ordered rules without repeats where a rule says so: an event is one row.

    `rule_no` counts in the given rules. Groups must not be hot: one is matched in one task.
    """

    prepared, ready = _prepared(df, rules, resolver)
    rows, index = indexed_events(prepared, rules, ready)
    keys, order = ["place", "group_key"], ["us", "sequence", "event_id"]
    # The rows are few and short for the matches that they make: their bytes say little of the work.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartition(tasks, *keys).sortWithinPartitions(*keys, *order)
    names = [f.split()[0] for f in MATCH_SCHEMA.split(", ")]
    return spread.mapInArrow(fold_events(index, rules, _words(rules), names), MATCH_SCHEMA)


def _free_for(stage: int, taken):
    def free(event):
        return (event["stage"] == stage) & ~F.exists(
            taken, lambda t: t["event_id"] == event["event_id"]
        )

    return free


def _unordered_matches(hits: DataFrame, number: int, rule: Rule) -> DataFrame:
    """At most one match per group: each stage takes its earliest event not yet taken.

    A stage can lose at most `stages - 1` of its events to earlier stages, so
    its earliest `stages` events are enough; they are kept by a ranked limit
    that Spark applies before the shuffle.
    """

    from pyspark.sql import Window as W

    stages = len(rule.stages)
    per_stage = hits.filter(F.col("rule_no") == number).select(
        "group_key",
        "us",
        "sequence",
        "event_id",
        "suppression",
        F.explode(
            F.filter(
                F.array(
                    *[
                        F.when(_bit(i), F.lit(i))
                        for i in range(stages)
                    ]
                ),
                lambda i: i.isNotNull(),
            )
        ).alias("stage"),
    )
    window = W.partitionBy("group_key", "stage").orderBy("us", "sequence", "event_id")
    earliest = per_stage.withColumn("rank", F.row_number().over(window)).filter(
        F.col("rank") <= stages
    )
    lists = earliest.groupBy("group_key").agg(
        F.array_sort(
            F.collect_list(F.struct("stage", "us", "sequence", "event_id", "suppression"))
        ).alias("events")
    )
    taken = F.array().cast(
        "array<struct<stage:int,us:bigint,sequence:bigint,event_id:string,suppression:string>>"
    )
    for i in range(stages):
        taken = F.concat(taken, F.slice(F.filter("events", _free_for(i, taken)), 1, 1))
    found = lists.select("group_key", taken.alias("taken")).filter(F.size("taken") == stages)
    times = F.transform("taken", lambda e: e["us"])
    matches = found.select(
        F.lit(number).alias("rule_no"),
        "group_key",
        F.transform("taken", lambda e: e["event_id"]).alias("event_ids"),
        F.array_min(times).alias("first_us"),
        F.array_max(times).alias("last_us"),
        F.col("taken")[0]["suppression"].alias("suppression"),
    )
    if rule.within_seconds is not None and stages > 1:
        limit = round(rule.within_seconds * 1e6)
        matches = matches.filter(F.col("last_us") - F.col("first_us") <= limit)
    return matches


def deduplicate(matches: DataFrame) -> DataFrame:
    """One row per rule, group and tuple of event ids."""

    return matches.groupBy("rule_no", "group_key", "event_ids").agg(
        F.min_by(F.struct("first_us", "last_us", "suppression"), "first_us").alias("m")
    ).select(
        "rule_no", "group_key", "event_ids", "m.first_us", "m.last_us", "m.suppression"
    )


def _suppress_partitions(limits):
    """mapInArrow function: keep a match only if the last kept one lies far enough back."""

    def run(batches):
        def kept():
            current, last = None, None
            for rule_no, group_key, ids, first, end, key, burst in _rows(batches):
                here = (rule_no, group_key, key, burst)
                if here != current:
                    current, last = here, None
                limit = limits[rule_no]
                if limit is not None and last is not None and first - last <= limit:
                    continue
                last = first
                yield (rule_no, group_key, ids, first, end, key)

        yield from _emit(kept())

    return run


def suppress(matches: DataFrame, rules) -> DataFrame:
    """Drop matches that start within the suppression time of the last emitted match.

    State lives per group and suppression key. A pause longer than the limit
    always lets the next match through, so every burst between two such pauses
    is folded alone, on whichever task it hashes to.
    """

    limits = [
        None if r.suppression_seconds is None else round(r.suppression_seconds * 1e6) for r in rules
    ]
    if all(limit is None for limit in limits):
        return matches
    keys = ["rule_no", "group_key", "suppression"]
    # Everything below reads the matches again and again: they are computed once.
    matches = cut(matches.withColumn("__ids", F.to_json("event_ids")))
    hot = has_hot_group(matches, keys)
    spaced = in_order(
        matches, keys, ["first_us", "last_us", "__ids"], {"before_us": ("lag", "first_us")}, hot
    )
    limit = F.element_at(
        F.array(*[F.lit(v).cast("bigint") for v in limits]), F.col("rule_no") + 1
    )
    opens = F.when(
        F.col("before_us").isNull()
        | limit.isNull()
        | (F.col("first_us") - F.col("before_us") > limit),
        F.col("first_us"),
    )
    bursts = in_order(
        spaced.withColumn("__opens", opens),
        keys,
        ["first_us", "last_us", "__ids"],
        {"burst": ("carry_forward", "__opens")},
        hot,
    )
    rows = bursts.select(
        "rule_no", "group_key", "event_ids", "first_us", "last_us", "suppression", "burst"
    )
    spread = rows.repartition(*keys, "burst").sortWithinPartitions(
        *keys, "burst", "first_us", "last_us"
    )
    return spread.mapInArrow(_suppress_partitions(limits), MATCH_SCHEMA)


def evaluate_rules(
    df: DataFrame, rules, *, rule_ids=None, resolver: Resolver | None = None
) -> DataFrame:
    """Matches of all rules in one pass over the events.

    Columns: rule_id, rule_name, rule_version, severity, tags (array),
    required_evidence_quality, group_key (array), event_ids (array), first_us and last_us.
    """

    rules = [r for r in rules if r.stages and (rule_ids is None or r.rule_id in rule_ids)]
    resolver = resolver or Resolver()
    ordered = [i for i, r in enumerate(rules) if r.ordered]
    found, whole = [], []
    if ordered:
        chosen = [rules[i] for i in ordered]
        hot = _may_be_hot(df, chosen, resolver)
        indexed = _indexed(df, rules) and not hot
    # Most of the rows of many rules, and their part of the plan, are only made where needed.
    hits = candidates(df, rules, resolver) if len(ordered) < len(rules) or not indexed else None
    if ordered:
        if indexed:
            one = _indexed_matches(df, chosen, resolver)
            if len(ordered) < len(rules):
                place = F.element_at(F.array(*[F.lit(i) for i in ordered]), F.col("rule_no") + 1)
                one = one.withColumn("rule_no", place)
            whole.append(one)
        else:
            own = hits if len(ordered) == len(rules) else hits.filter(F.col("rule_no").isin(ordered))
            found.append(_ordered_matches(own, rules, hot))
    found += [_unordered_matches(hits, i, r) for i, r in enumerate(rules) if not r.ordered]
    if found:
        matches = found[0]
        for other in found[1:]:
            matches = matches.unionByName(other)
        unique = [i for i, r in enumerate(rules) if r.deduplicate]
        if len(unique) == len(rules):
            matches = deduplicate(matches)
        elif unique:
            kept = F.col("rule_no").isin(unique)
            matches = deduplicate(matches.filter(kept)).unionByName(matches.filter(~kept))
        whole.append(matches)
    matches = whole[0]
    for other in whole[1:]:
        matches = matches.unionByName(other)
    matches = suppress(matches, rules)

    def constant(values):
        # One text for all rules: a column for each of them takes longer to make than the matches.
        texts = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
        return F.element_at(F.expr(f"array({texts})"), F.col("rule_no") + 1)

    return matches.select(
        constant([r.rule_id for r in rules]).alias("rule_id"),
        constant([r.name for r in rules]).alias("rule_name"),
        constant([r.version for r in rules]).alias("rule_version"),
        constant([r.severity for r in rules]).alias("severity"),
        F.from_json(constant([json.dumps(r.tags) for r in rules]), "array<string>").alias("tags"),
        F.from_json(
            constant([json.dumps(r.required_evidence_quality) for r in rules]), "array<string>"
        ).alias("required_evidence_quality"),
        F.from_json("group_key", "array<string>").alias("group_key"),
        "event_ids",
        "first_us",
        "last_us",
    )


def alert_rows(matches: DataFrame) -> DataFrame:
    """One row per matched event with its stage index."""

    return matches.select(
        "rule_id",
        "rule_name",
        "rule_version",
        "severity",
        "tags",
        "required_evidence_quality",
        "group_key",
        F.posexplode("event_ids").alias("stage_index", "event_id"),
    )


def explain_rule(df: DataFrame, rule: Rule, resolver: Resolver | None = None) -> DataFrame:
    """Per group and stage: how many events qualify, out of how many in the group."""

    resolver = resolver or Resolver()
    keyed = group_keys(df, rule.group_by, resolver)
    counts = keyed.groupBy("group_key").agg(
        F.count(F.lit(1)).alias("event_count"),
        *[
            F.count_if(stage_condition(resolver, stage)).alias(f"stage_{i}")
            for i, stage in enumerate(rule.stages)
        ],
    )
    stages = F.array(
        *[
            F.struct(
                F.lit(i).alias("stage_index"),
                F.lit(stage.event_type).alias("event_type"),
                F.col(f"stage_{i}").alias("candidates"),
            )
            for i, stage in enumerate(rule.stages)
        ]
    )
    return counts.select("group_key", "event_count", F.explode(stages).alias("s")).select(
        "group_key", "event_count", "s.*"
    )


def explain_candidates(df: DataFrame, rule: Rule, resolver: Resolver | None = None) -> DataFrame:
    """The candidate event ids behind `explain_rule`, one row each, without payloads."""

    resolver = resolver or Resolver()
    stages = [
        F.when(stage_condition(resolver, stage), F.lit(i)) for i, stage in enumerate(rule.stages)
    ]
    return group_keys(df, rule.group_by, resolver).select(
        "group_key",
        "event_id",
        F.explode(F.filter(F.array(*stages), lambda i: i.isNotNull())).alias("stage_index"),
    )
