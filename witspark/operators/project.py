"""Flat event projection, timelines, filters, summaries and explanations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from witspark import schema as S
from witspark.functions.jsonwalk import walk_json
from witspark.functions.payload import kind_of, text_at, variant_at
from witspark.operators.ordered import in_order
from witspark.plans.lineage import Rounds, cut

TOOL_KEYS = ("name", "tool", "tool_name")
RESOURCE_KEYS = ("identifier", "path", "uri", "url")
CLAIM = "Nothing observed does not mean that nothing happened."
TIMELINE_ORDER = ("occurred_at", "sequence", "journal_record_number", "event_id")


EVIDENCE_COLUMNS = ("verification_status", "evidence_subject_event_id", "evidence_event_id")


def _parse_link(df: DataFrame) -> DataFrame:
    payload = F.col("payload_v")
    df = df.withColumn("__link", variant_at(payload, "evidence_link"))
    link = F.col("__link")
    struct = F.struct(
        text_at(link, "subject_event_id").alias("subject_event_id"),
        text_at(link, "relationship").alias("relationship"),
        text_at(link, "evidence_event_id").alias("evidence_event_id"),
        text_at(link, "corroboration_type").alias("corroboration_type"),
        text_at(link, "observer_identity").alias("observer_identity"),
        F.try_variant_get(link, "$.confidence", "double").alias("confidence"),
        text_at(link, "verification_status").alias("verification_status"),
        F.try_variant_get(link, "$.limitations", "array<string>").alias("limitations"),
    )
    return df.select(
        "*",
        F.when(kind_of(link) == "OBJECT", struct).alias("evidence_link"),
        text_at(payload, "verification_status").alias("payload_status"),
        text_at(payload, "subject_event_id").alias("payload_subject"),
        text_at(payload, "evidence_event_id").alias("payload_evidence"),
    ).drop("__link")


def evidence_columns(df: DataFrame, flavour: str = "a") -> DataFrame:
    """Add the link as a struct, and status, subject and evidence id of each event.

    Flavour a: a link object wins entirely, even where its members are null.
    Flavour b: the status falls back to the payload, the ids never do.
    """

    if "evidence_link" not in df.columns:
        df = _parse_link(df)
    else:
        df = df.drop(*EVIDENCE_COLUMNS)
    own = F.col("evidence_link")
    if flavour == "a":
        status = F.when(own.isNotNull(), own["verification_status"]).otherwise(
            F.col("payload_status")
        )
        subject = F.when(own.isNotNull(), own["subject_event_id"]).otherwise(
            F.col("payload_subject")
        )
        evidence = F.when(own.isNotNull(), own["evidence_event_id"]).otherwise(
            F.col("payload_evidence")
        )
    else:
        status = F.coalesce(own["verification_status"], F.col("payload_status"))
        subject, evidence = own["subject_event_id"], own["evidence_event_id"]
    return df.select(
        "*",
        status.alias("verification_status"),
        subject.alias("evidence_subject_event_id"),
        evidence.alias("evidence_event_id"),
    )


def project(df: DataFrame, flavour: str = "a", number: str = "record_number") -> DataFrame:
    """The flat projection: 19 columns, or 20 with the digest of the text in flavour b."""

    rows = evidence_columns(df, flavour).select(
        "*", F.col(number).alias("journal_record_number"), F.col("line").alias("event_json")
    )
    columns = [F.col(c) for c in S.PROJECTED_COLUMNS]
    if flavour == "b":
        columns.append(
            F.concat(F.lit("sha256:"), F.sha2("event_json", 256)).alias("event_json_sha256")
        )
    return rows.select(*columns)


def projection_conflicts(df: DataFrame) -> DataFrame:
    """Event ids projected more than once: `no_op` if all copies agree, else `conflict`."""

    same = F.sha2(F.concat_ws("|", F.col("journal_record_number"), F.col("event_json")), 256)
    copies = df.select("event_id", same.alias("content")).groupBy("event_id").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min("content").alias("low"),
        F.max("content").alias("high"),
    )
    return copies.filter("copies > 1").select(
        "event_id",
        "copies",
        F.when(F.col("low") == F.col("high"), "no_op").otherwise("conflict").alias("outcome"),
    )


def upgrade_projection(df: DataFrame) -> DataFrame:
    """Old projection rows in the current schema: three nullable columns are added."""

    added = ("verification_status", "evidence_subject_event_id", "evidence_event_id")
    for name in added:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    return df


def write_projection(df: DataFrame, path: str) -> None:
    """Projection on disk by day, sorted by run inside each file for pruning."""

    daily = df.withColumn("occurred_on", F.to_date("occurred_at"))
    (
        daily.repartition("occurred_on", F.pmod(F.xxhash64("run_id"), F.lit(64)))
        .sortWithinPartitions("run_id", "occurred_at")
        .write.partitionBy("occurred_on")
        .mode("overwrite")
        .parquet(path)
    )


def timeline(df: DataFrame, *, trace_id: str | None = None, run_id: str | None = None) -> DataFrame:
    """Events of exactly one trace or run in event order."""

    if (trace_id is None) == (run_id is None):
        raise ValueError("give exactly one of trace_id and run_id")
    chosen = F.col("trace_id") == trace_id if run_id is None else F.col("run_id") == run_id
    order = [c for c in TIMELINE_ORDER if c in df.columns]
    return df.filter(chosen).orderBy(*order)


def timeline_positions(df: DataFrame, by: str = "trace_id", order=("occurred_at", "sequence", "event_id")) -> DataFrame:
    """Every timeline at once: the place of each event in its own trace or run."""

    return in_order(df, [by], list(order), {"position": ("row_number", None)})


_PLAIN_FILTERS = {
    "trace_id": "trace_id",
    "run_id": "run_id",
    "event_type": "event_type",
    "principal_id": "principal_id",
    "verification_status": "verification_status",
    "sensitivity": "sensitivity",
    "trust": "trust",
}


def filtered_timeline(df: DataFrame, *, ids=("event_id",), payload="payload", **filters) -> DataFrame:
    """Conjunction of the given filters; column filters run before payloads are read."""

    unknown = set(filters) - set(_PLAIN_FILTERS) - {"tool_name", "resource", "descriptor_hash"}
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    for name, value in filters.items():
        if name in _PLAIN_FILTERS and value is not None:
            df = df.filter(F.col(_PLAIN_FILTERS[name]) == value)
    deep = []
    for name, keys in (("tool_name", TOOL_KEYS), ("descriptor_hash", ("descriptor_hash",))):
        if filters.get(name) is not None:
            deep.append(F.col("key").isin(*keys) & (F.col("text") == filters[name]))
    if filters.get("resource") is not None:
        deep.append(F.col("text") == filters["resource"])
    if deep:
        # A text that holds none of the wanted strings cannot match; skip its walk.
        for name in ("tool_name", "descriptor_hash", "resource"):
            if filters.get(name) is not None:
                escaped = json.dumps(filters[name], ensure_ascii=False)[1:-1]
                # An escape may spell it otherwise, so a text with a backslash is walked too.
                df = df.filter(F.col(payload).contains(escaped) | F.col(payload).contains("\\"))
        nodes = walk_json(df, list(ids), payload, kinds=("string",), fields=("key", "text"))
        hits = nodes.groupBy(*ids).agg(*[F.max(d).alias(f"hit_{i}") for i, d in enumerate(deep)])
        for i in range(len(deep)):
            hits = hits.filter(F.col(f"hit_{i}"))
        df = df.join(hits.select(*ids), list(ids), "left_semi")
    return df


def key_values(df: DataFrame, ids, payload: str, keys) -> DataFrame:
    """Distinct (ids, value) of all strings at any depth under one of the keys."""

    nodes = walk_json(df, list(ids), payload, keys=keys, kinds=("string",), fields=("text",))
    return nodes.select(*ids, F.col("text").alias("value")).distinct()


def string_values(df: DataFrame, ids, payload: str) -> DataFrame:
    """Distinct (ids, value) of all string leaves."""

    nodes = walk_json(df, list(ids), payload, kinds=("string",), fields=("text",))
    return nodes.select(*ids, F.col("text").alias("value")).distinct()


def _capture_text():
    parts = F.from_json("text", "array<string>")
    return F.concat(
        F.lit("[TRUNCATED original_length="),
        parts[0],
        F.lit(" digest="),
        parts[1],
        F.lit(" digest_scope="),
        parts[2],
        F.lit("]"),
    )


def summary_values(df: DataFrame, ids, payload: str, keys: dict[str, tuple]) -> DataFrame:
    """Distinct (ids, field, value) per named key set; captures show as short text.

    The members of a capture marker are not searched.
    """

    wanted = sorted({k for ks in keys.values() for k in ks})
    shown = ("key", "kind", "text", "inside_capture")
    nodes = walk_json(df, list(ids), payload, keys=wanted, kinds=("string", "capture"), fields=shown)
    nodes = nodes.filter(~F.col("inside_capture"))
    fields = F.array(*[F.when(F.col("key").isin(*ks), F.lit(f)) for f, ks in keys.items()])
    value = F.when(F.col("kind") == "capture", _capture_text()).otherwise(F.col("text"))
    return (
        nodes.select(*ids, F.explode(fields).alias("field"), value.alias("value"))
        .filter("field IS NOT NULL")
        .distinct()
    )


def incident_summary(df: DataFrame, by: str = "run_id") -> DataFrame:
    """Facts of every incident, one row each: (by, field, value, events).

    Fields: principals, tools, resources, limitations, verification_statuses,
    evidence_links (subject<-evidence), conflicting_event_ids,
    unknown_event_ids and detection_hit_event_ids. Long rows keep an incident
    of any size spread over the cluster.
    """

    link = F.col("evidence_link")
    plain = F.array(
        F.struct(F.lit("principals").alias("field"), F.col("principal_id").alias("value")),
        F.struct(
            F.lit("verification_statuses").alias("field"),
            F.col("verification_status").alias("value"),
        ),
        F.struct(
            F.lit("evidence_links").alias("field"),
            F.when(
                link.isNotNull(),
                F.concat(
                    F.coalesce(link["subject_event_id"], F.lit("")),
                    F.lit("<-"),
                    F.coalesce(link["evidence_event_id"], F.lit("")),
                ),
            ).alias("value"),
        ),
        F.struct(
            F.lit("conflicting_event_ids").alias("field"),
            F.when(
                F.col("event_type") == "side_effect.conflict_detected", F.col("event_id")
            ).alias("value"),
        ),
        F.struct(
            F.lit("unknown_event_ids").alias("field"),
            F.when(F.col("verification_status") == "unknown", F.col("event_id")).alias("value"),
        ),
        F.struct(
            F.lit("detection_hit_event_ids").alias("field"),
            F.when(F.col("event_type") == "lineage.alert.created", F.col("event_id")).alias("value"),
        ),
    )
    limits = F.transform(
        F.coalesce(link["limitations"], F.array().cast("array<string>")),
        lambda x: F.struct(F.lit("limitations").alias("field"), x.alias("value")),
    )
    flat = df.select(by, F.explode(F.concat(plain, limits)).alias("f")).select(by, "f.*")
    flat = flat.filter("value IS NOT NULL")
    deep = summary_values(
        df, [by, "event_id"], "payload", {"tools": TOOL_KEYS, "resources": RESOURCE_KEYS}
    ).select(by, "field", "value")
    return (
        flat.unionByName(deep)
        .groupBy(by, "field", "value")
        .agg(F.count(F.lit(1)).alias("events"))
    )


def status_counts(df: DataFrame, by=(), missing: str | None = "unknown") -> DataFrame:
    """Events per verification status; events without one count as `missing`, or not at all."""

    status = F.col("verification_status")
    if missing is None:
        df = df.filter(status.isNotNull())
    else:
        df = df.withColumn("verification_status", F.coalesce(status, F.lit(missing)))
    return df.groupBy(*by, "verification_status").agg(F.count(F.lit(1)).alias("events"))


def grounded_summary(df: DataFrame, by: str = "run_id") -> DataFrame:
    """One headline per incident, counted from its events."""

    counts = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("verification_status") == "verified").alias("verified"),
        F.count_if(F.col("verification_status").isin(*S.UNCERTAIN_STATUSES)).alias("uncertain"),
        F.count_if(F.col("evidence_link").isNotNull()).alias("links"),
        F.count_if(F.col("event_type") == "side_effect.conflict_detected").alias("conflicts"),
        *[
            F.count_if(F.col("verification_status") == s).alias(f"status_{s}")
            for s in sorted(S.STATUSES)
        ],
    )
    shown = F.concat_ws(
        ", ",
        *[
            F.when(
                F.col(f"status_{s}") > 0, F.concat(F.lit(f"{s}="), F.col(f"status_{s}").cast("string"))
            )
            for s in sorted(S.STATUSES)
        ],
    )
    return counts.select(
        by,
        F.format_string(
            f"%d events for {by}=%s; %d verified and %d uncertain outcomes recorded.",
            "events",
            by,
            "verified",
            "uncertain",
        ).alias("headline"),
        F.concat(
            F.lit("Verification statuses: "),
            F.when(shown == "", "none recorded").otherwise(shown),
        ).alias("statuses"),
        F.format_string("Evidence links: %d", "links").alias("link_line"),
        F.when(F.col("conflicts") == 0, "Conflicting events: none recorded")
        .otherwise(F.format_string("Conflicting events: %d", "conflicts"))
        .alias("conflict_line"),
        F.lit(CLAIM).alias("claim"),
    )


def explain_events(df: DataFrame, event_id: str | None = None) -> DataFrame:
    """Relations of one event, or of all: parent, child, link as subject, link as evidence."""

    known = df.select("event_id")
    links = df.filter(F.col("evidence_link").isNotNull())
    parts = [
        df.select("event_id", F.lit("parent").alias("relation"), F.col("parent_event_id").alias("other")),
        df.select(F.col("parent_event_id").alias("event_id"), F.lit("child"), "event_id"),
        links.select("evidence_link.subject_event_id", F.lit("link_as_subject"), "event_id"),
        links.select("evidence_link.evidence_event_id", F.lit("link_as_evidence"), "event_id"),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    rows = rows.filter("event_id IS NOT NULL AND other IS NOT NULL")
    if event_id is not None:
        return rows.filter(F.col("event_id") == event_id)
    return rows.join(known, "event_id", "left_semi")


def causal_depth(df: DataFrame) -> DataFrame:
    """Root and depth of every event over parent links, by pointer doubling.

    Round r knows the ancestor 2^r steps up, so a chain of a million events
    needs 20 joins on the event id; no pair of events beyond that is made. An
    event whose parent is not in the table counts as a root. Events in a cycle
    have no root and are left out of no result: their root stays null.
    """

    nodes = df.select("event_id", F.col("parent_event_id").alias("up"))
    present = nodes.select(F.col("event_id").alias("up"))
    linked = nodes.join(present, "up", "left_semi").select("event_id", "up")
    state = nodes.select("event_id").join(linked, "event_id", "left").select(
        "event_id",
        "up",
        F.when(F.col("up").isNull(), F.col("event_id")).alias("root"),
        F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("depth"),
    )
    state = cut(state)
    # A round settles events as long as some chain goes on; what is left then is cycles.
    left, before = state.filter("up IS NOT NULL").count(), None
    while left and left != before:
        above = state.select(
            F.col("event_id").alias("up"),
            F.col("up").alias("next"),
            F.col("root").alias("above_root"),
            F.col("depth").alias("above_depth"),
        )
        state = cut(
            state.join(above, "up", "left").select(
                "event_id",
                F.col("next").alias("up"),
                F.coalesce("root", "above_root").alias("root"),
                (F.col("depth") + F.coalesce("above_depth", F.lit(0))).alias("depth"),
            )
        )
        left, before = state.filter("up IS NOT NULL").count(), left
    return state.select(
        "event_id",
        F.when(F.col("up").isNull(), F.col("root")).alias("root"),
        F.when(F.col("up").isNull(), F.col("depth")).alias("depth"),
    )


def causal_closure(df: DataFrame, seeds: DataFrame, direction: str = "ancestors") -> DataFrame:
    """(seed, event_id, depth) reached from the seeds over parent links, in doubling rounds.

    Round r has everything less than 2^r steps away, and a table of jumps over exactly
    2^r steps; one join of the two gives all that lies 2^r to 2^(r+1) steps away, and
    the jumps joined with themselves are the next ones. So a chain of a million events
    takes 20 rounds, and a row of the result is made once. Descendants go the jumps
    backwards. A depth that a round reaches for the first time implies the depths
    before it, so a round with nothing new is the last; an event reached before is not
    taken again, which ends cycles and keeps the least depth. A seed that lies on a
    cycle is not its own ancestor.
    """

    rounds = Rounds(df.sparkSession, "closure")
    known = df.select(F.col("event_id").alias("up")).distinct()
    links = df.filter("parent_event_id IS NOT NULL").select(
        F.col("event_id").alias("down"), F.col("parent_event_id").alias("up")
    )
    # Each jump leads from an event to the one above it.
    jumps = rounds.keep("jumps", links.distinct().join(known, "up", "left_semi").select("down", "up"))
    start, end = ("down", "up") if direction == "ancestors" else ("up", "down")
    asked = seeds.filter("event_id IS NOT NULL")
    _, reached = rounds.add(
        "reached", asked.select(F.col("event_id").alias("seed"), "event_id", F.lit(0).alias("depth")).distinct()
    )
    step = 1
    while True:
        further = jumps.select(F.col(start).alias("event_id"), F.col(end).alias("to"))
        near = (
            reached.join(further, "event_id")
            .groupBy("seed", F.col("to").alias("event_id"))
            .agg((F.min("depth") + step).alias("depth"))
        )
        fresh = near.join(reached.select("seed", "event_id"), ["seed", "event_id"], "left_anti")
        new, reached = rounds.add("reached", fresh)
        if new.isEmpty():
            return reached.filter("depth > 0")
        upper = jumps.select(F.col("down").alias("up"), F.col("up").alias("next"))
        jumps = rounds.keep("jumps", jumps.join(upper, "up").select("down", F.col("next").alias("up")).distinct())
        step *= 2


def console_tables(df: DataFrame) -> dict[str, DataFrame]:
    """The tables behind an analyst view of the given timeline."""

    link = F.col("evidence_link")
    dash = F.lit("-")
    parents = df.select(F.col("event_id").alias("parent_event_id"))
    linked = df.filter(link.isNotNull())
    here = df.select("event_id")
    ends = linked.select(
        "event_id",
        F.col("evidence_link.subject_event_id").alias("source"),
        F.col("evidence_link.evidence_event_id").alias("target"),
        F.coalesce("evidence_link.relationship", F.lit("evidence")).alias("relationship"),
    )
    return {
        "timeline": df.select(
            "sequence",
            "occurred_at",
            "event_type",
            "event_id",
            F.coalesce("parent_event_id", F.lit("root")).alias("parent"),
        ),
        "verification": df.select(
            "event_id",
            F.coalesce(link["verification_status"], "payload_status", F.lit("unknown")).alias(
                "status"
            ),
            F.coalesce("evidence_event_id", dash).alias("evidence"),
            F.coalesce("evidence_subject_event_id", dash).alias("subject"),
        ),
        "links": linked.select(
            "event_id",
            *[
                F.coalesce(link[name].cast("string"), dash).alias(name)
                for name in (
                    "relationship",
                    "subject_event_id",
                    "evidence_event_id",
                    "observer_identity",
                    "confidence",
                )
            ],
        ),
        "causal_edges": df.join(parents, "parent_event_id", "left_semi").select(
            F.col("parent_event_id").alias("source"), F.col("event_id").alias("target")
        ),
        "evidence_edges": ends.join(
            here.withColumnRenamed("event_id", "source"), "source", "left_semi"
        ).join(here.withColumnRenamed("event_id", "target"), "target", "left_semi"),
    }
