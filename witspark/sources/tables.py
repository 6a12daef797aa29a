"""The given tables seen as evidence tables.

`events` becomes the event table, `conversations` the journals, `documents` the
texts to redact and audit, `orders` and `lineitem` expectations and receipts.
The mappings are row-wise expressions over whole tables, written once in the
SQL subset that both Spark and the checking engine read, so that a check
compares operators and not two spellings of the same mapping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from witspark import schema as S
from witspark.functions.digest import sorted_json
from witspark.functions.times import canonical_ts
from witspark.operators.ordered import in_order
from witspark.operators.project import evidence_columns
from witspark.plans.lineage import written_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TYPE = """CASE event_type
 WHEN 'signup' THEN CASE k % 10 WHEN 0 THEN 'policy.decision' WHEN 1 THEN 'agent.tool.schema_changed'
   WHEN 2 THEN 'agent.run.completed' ELSE 'agent.run.started' END
 WHEN 'view' THEN CASE k % 10 WHEN 0 THEN 'tool.execution.authorized' WHEN 1 THEN 'action.normalized'
   WHEN 2 THEN 'custom.probe' WHEN 3 THEN 'tool.execution.not_dispatched' ELSE 'tool.execution.requested' END
 WHEN 'click' THEN CASE WHEN k % 10 < 3 THEN 'tool.execution.dispatched' ELSE 'tool.execution.acknowledged' END
 WHEN 'purchase' THEN CASE WHEN k % 10 < 3 THEN 'side_effect.observed' ELSE 'side_effect.verified' END
 ELSE CASE k % 10 WHEN 0 THEN 'side_effect.conflict_detected' WHEN 1 THEN 'side_effect.timed_out'
   WHEN 2 THEN 'lineage.alert.created' ELSE 'side_effect.unverified' END END"""

# Three layers: each may name the columns of the one before.
LAYER_1 = {
    "n": "event_id",
    "event_id": "'evt_' || CAST(event_id AS STRING)",
    "source_type": "event_type",
    "event_type": _TYPE,
    "occurred_at": "ts",
    "trace_id": "'trace_' || CAST(user_id AS STRING)",
    "run_id": "'run_' || CAST(user_id AS STRING) || CASE WHEN day(ts) < 11 THEN '_a'"
    " WHEN day(ts) < 21 THEN '_b' ELSE '_c' END",
    "user_id": "user_id",
    "k": "k",
    "value": "value",
}
LAYER_2 = {
    "has_link": "event_type LIKE 'side_effect.%' AND k % 6 <> 0",
    "status_word": "CASE event_type WHEN 'side_effect.observed' THEN 'observed'"
    " WHEN 'side_effect.verified' THEN 'verified' WHEN 'side_effect.timed_out' THEN 'timed_out'"
    " WHEN 'side_effect.conflict_detected' THEN 'conflicting'"
    " WHEN 'side_effect.unverified' THEN 'unverified' WHEN 'lineage.alert.created'"
    " THEN CASE WHEN k % 4 = 0 THEN '' ELSE 'unknown' END END",
    "tool_name": "CASE k % 4 WHEN 0 THEN 'safe_http.send' WHEN 1 THEN 'safe_files.read'"
    " WHEN 2 THEN 'service_api.read' END",
    "resource_id": "CASE WHEN k % 5 <> 0 THEN 'file:///data/' || CAST(k % 20 AS STRING) || '.txt' END",
    "principal_id": "'user_' || CAST(user_id % 10 AS STRING)",
    "principal_type": "CASE user_id % 3 WHEN 0 THEN 'agent' WHEN 1 THEN 'service' ELSE 'human' END",
    "sensitivity": "CASE k % 6 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'confidential'"
    " WHEN 3 THEN 'restricted' WHEN 4 THEN 'secret' ELSE 'unknown' END",
    "trust": "CASE k % 5 WHEN 0 THEN 'trusted' WHEN 1 THEN 'untrusted' WHEN 2 THEN 'local'"
    " WHEN 3 THEN 'external' ELSE 'unknown' END",
    "label": "CAST(k % 10 AS STRING)",
    "flag": "k % 2 = 0",
    "sens_resource": "CASE WHEN event_type = 'action.normalized' THEN"
    " CASE WHEN k % 20 < 10 THEN 'restricted' ELSE 'public' END END",
    "ack_status": "CASE WHEN event_type = 'tool.execution.acknowledged' THEN"
    " CASE k % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'succeeded' ELSE 'failed' END END",
    "ack_note": "CASE WHEN event_type = 'tool.execution.acknowledged' AND k % 2 = 0 THEN 'ack only' END",
    "outcome": "CASE WHEN event_type = 'policy.decision' THEN CASE WHEN k % 30 < 10 THEN 'deny'"
    " WHEN k % 30 < 20 THEN 'error' ELSE 'allow' END END",
    "forwarded": "CASE WHEN event_type = 'tool.execution.not_dispatched' THEN k % 20 < 10 END",
    "concurrent_child": "CASE WHEN event_type = 'agent.run.started' THEN k % 4 = 3 END",
}
LAYER_3 = {
    "descriptor_hash": "CASE WHEN tool_name IS NOT NULL THEN CASE WHEN k % 12 = 5 THEN 'md5:' ELSE 'sha256:' END"
    " || {sha}('descriptor:' || tool_name || ':' || CAST(k % 3 AS STRING){sha_end}) END",
    "top_status": "CASE WHEN NOT has_link OR k % 8 = 0 THEN status_word END",
    "link_status": "CASE WHEN has_link AND k % 8 <> 0 THEN status_word END",
    "link_subject": "CASE WHEN has_link THEN CASE WHEN k % 11 = 0 THEN 'evt_missing_' || CAST(n AS STRING)"
    " WHEN k % 13 = 0 THEN '' ELSE 'evt_' || CAST(n - 1 AS STRING) END END",
    "link_evidence": "CASE WHEN has_link AND k % 15 <> 0 THEN 'evt_' || CAST(n - 2 AS STRING) END",
    "link_relationship": "CASE WHEN has_link THEN CASE WHEN k % 14 = 0 THEN 'endorses'"
    " WHEN event_type = 'side_effect.verified' THEN 'corroborates'"
    " WHEN event_type = 'side_effect.conflict_detected' THEN 'contradicts'"
    " WHEN event_type = 'side_effect.observed' THEN 'observes' ELSE 'limits' END END",
    "link_corroboration": "CASE WHEN has_link THEN CASE k % 5 WHEN 0 THEN 'independent_observer'"
    " WHEN 1 THEN 'post_action_readback' WHEN 2 THEN 'fixture_oracle' WHEN 3 THEN 'self_reported'"
    " ELSE 'unknown' END END",
    "link_observer": "CASE WHEN has_link THEN 'observer_' || CAST(k % 3 AS STRING) END",
    "link_confidence": "CASE WHEN has_link THEN CAST(k AS DOUBLE) / 80.0 END",
    "limit_text": "CASE WHEN has_link THEN CASE k % 4 WHEN 0 THEN 'local only'"
    " WHEN 1 THEN 'local only|fixture' WHEN 2 THEN '' ELSE '|late' END END",
}

_SPARK = {"sha": "sha2", "sha_end": ", 256"}
_CHECK = {"sha": "sha256", "sha_end": ""}

CHECK_BASE = (
    "SELECT event_id, ts, user_id, event_type, value,"
    " CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events"
)


def check_events() -> str:
    """The event table as a CTE list for the checking engine.

    `ev` holds the mapped rows, `evc` adds causality, `evp` the evidence columns.
    """

    def layer(columns, source, keep):
        shown = ", ".join(
            f"{text.format(**_CHECK)} AS {name}" for name, text in columns.items()
        )
        return f"SELECT {keep}{shown} FROM {source}"

    order = "PARTITION BY run_id ORDER BY occurred_at, n"
    return (
        f"ev0 AS ({CHECK_BASE}), ev1 AS ({layer(LAYER_1, 'ev0', '')}),"
        f" ev2 AS ({layer(LAYER_2, 'ev1', 'ev1.*, ')}),"
        f" ev AS ({layer(LAYER_3, 'ev2', 'ev2.*, ')}),"
        " evc AS (SELECT ev.*,"
        f" row_number() OVER ({order}) - 1 AS sequence,"
        f" lag(event_id) OVER ({order}) AS parent_event_id,"
        f" first_value(event_id) OVER ({order}) AS root_event_id FROM ev),"
        " evp AS (SELECT evc.*,"
        " CASE WHEN has_link THEN nullif(link_status, '') ELSE nullif(top_status, '') END AS status,"
        " coalesce(nullif(link_status, ''), nullif(top_status, '')) AS status_b,"
        " nullif(link_subject, '') AS subject, nullif(link_evidence, '') AS evidence FROM evc)"
    )


def _limitations(text: str = "limit_text"):
    col = F.col(text)
    return F.when(col == "", F.array().cast("array<string>")).otherwise(F.split(col, r"\|"))


def _optional(condition, struct):
    return F.when(condition, struct)


def payload_json():
    """The schemaless payload of the mapped events, as JSON text without null members."""

    return F.to_json(
        F.struct(
            "k",
            "value",
            "label",
            "flag",
            _optional(
                F.col("tool_name").isNotNull(),
                F.struct(F.col("tool_name").alias("name"), "descriptor_hash"),
            ).alias("tool_identity"),
            _optional(
                F.col("resource_id").isNotNull(),
                F.struct(F.col("resource_id").alias("identifier")),
            ).alias("resource"),
            _optional(
                F.col("ack_status").isNotNull(),
                F.struct(F.col("ack_status").alias("status"), F.col("ack_note").alias("note")),
            ).alias("acknowledgement"),
            F.col("outcome"),
            _optional(
                F.col("forwarded").isNotNull(),
                F.struct(F.col("forwarded").alias("downstream_forwarded")),
            ).alias("not_dispatched"),
            _optional(
                F.col("concurrent_child").isNotNull(), F.struct("concurrent_child")
            ).alias("run"),
            _optional(
                F.col("sens_resource").isNotNull(),
                F.struct(
                    F.array(
                        F.struct(
                            F.struct(F.col("sens_resource").alias("sensitivity")).alias(
                                "attributes"
                            )
                        )
                    ).alias("resources")
                ),
            ).alias("action"),
            canonical_ts(F.col("occurred_at")).alias("seen_at"),
            F.col("top_status").alias("verification_status"),
            _optional(
                F.col("has_link"),
                F.struct(
                    F.col("link_subject").alias("subject_event_id"),
                    F.col("link_relationship").alias("relationship"),
                    F.col("link_evidence").alias("evidence_event_id"),
                    F.col("link_corroboration").alias("corroboration_type"),
                    F.col("link_observer").alias("observer_identity"),
                    F.col("link_confidence").alias("confidence"),
                    F.col("link_status").alias("verification_status"),
                    _limitations().alias("limitations"),
                ),
            ).alias("evidence_link"),
        )
    )


def _ordered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` with the columns of the first layer and causality."""

    base = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"),
    )
    df = base.selectExpr(*[f"{text} AS {name}" for name, text in LAYER_1.items()])
    # The ordering step also keeps the layers from being folded into one another.
    return with_causality(df)


def causal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The few columns that say which event came from which, with the event's type and time."""

    return written_table(spark, "causal-events", sf_dir, lambda: _ordered_events(spark, sf_dir))


def mapped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` with causality and the derived columns, one row per source row."""

    df = _ordered_events(spark, sf_dir)
    for layer in (LAYER_2, LAYER_3):
        df = df.selectExpr(
            "*", *[f"{text.format(**_SPARK)} AS {name}" for name, text in layer.items()]
        )
    return df


def _build_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped_events(spark, sf_dir).select(
        "*",
        F.lit(S.SPEC_VERSION).alias("spec_version"),
        F.col("occurred_at").alias("observed_at"),
        F.lit("recorder").alias("source_component"),
        F.concat(F.lit("recorder_"), F.col("user_id") % 5).alias("source_instance_id"),
        F.lit("1").alias("source_version"),
        F.lit(None).cast("string").alias("span_id"),
        F.lit(None).cast("string").alias("session_id"),
        payload_json().alias("payload"),
    )


def flat_events(spark: SparkSession, sf_dir: str, *, payload: bool = True) -> DataFrame:
    """The flat event table: envelope columns, causality, and the payload as JSON text.

    With `payload` the text is also given as VARIANT, `payload_v`.
    """

    df = written_table(spark, "events", sf_dir, lambda: _build_events(spark, sf_dir))
    if payload:
        df = df.withColumn("payload_v", F.try_parse_json("payload"))
    return df


def evidence_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table with its evidence columns materialised."""

    return written_table(
        spark,
        "evidence",
        sf_dir,
        lambda: evidence_columns(flat_events(spark, sf_dir)).drop("payload_v"),
    )


def with_causality(df: DataFrame) -> DataFrame:
    numbered = in_order(
        df,
        ["run_id"],
        ["occurred_at", "n"],
        {
            "position": ("row_number", None),
            "parent_event_id": ("lag", "event_id"),
            "root_event_id": ("first", "event_id"),
        },
    )
    return numbered.withColumn("sequence", F.col("position") - 1).drop("position")


def event_line(df: DataFrame, *, previous_hash=None, event_hash=None) -> DataFrame:
    """Add `line`: the canonical text of each event, keys sorted at every level."""

    null = F.lit(None).cast("string")
    envelope = sorted_json(
        causality=F.struct("parent_event_id", "root_event_id", "sequence"),
        classification=F.struct("sensitivity", "trust"),
        correlation=F.struct("run_id", "session_id", "span_id", "trace_id"),
        event_id=F.col("event_id"),
        event_type=F.col("event_type"),
        integrity=F.struct(
            F.lit(S.CANONICALIZATION).alias("canonicalization"),
            (null if event_hash is None else event_hash).alias("event_hash"),
            (null if previous_hash is None else previous_hash).alias("previous_event_hash"),
        ),
        observed_at=canonical_ts(F.col("observed_at")),
        occurred_at=canonical_ts(F.col("occurred_at")),
        payload=F.struct(F.lit("payload").alias("slot")),
        principal=F.struct(
            null.alias("credential_id"),
            null.alias("model_id"),
            null.alias("on_behalf_of"),
            "principal_id",
            "principal_type",
        ),
        source=F.struct(
            F.col("source_component").alias("component"),
            F.col("source_instance_id").alias("instance_id"),
            F.col("source_version").alias("version"),
        ),
        spec_version=F.col("spec_version"),
    )
    # VARIANT text has sorted keys already; it takes the place of the slot.
    whole = F.replace(
        envelope, F.lit('"payload":{"slot":"payload"}'), F.concat(F.lit('"payload":'), F.to_json("payload_v"))
    )
    return df.withColumn("line", whole)


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conversations` as journals: one journal per conversation, one event per turn."""

    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        F.concat(F.lit("journal_"), F.col("conv_id")).alias("journal_id"),
        "conv_id",
        (F.col("turn") + 1).alias("record_number"),
        F.concat_ws("_", F.lit("msg"), "conv_id", "turn").alias("event_id"),
        F.lit(S.SPEC_VERSION).alias("spec_version"),
        F.when(F.col("turn") == 0, "agent.run.started")
        .when(F.col("role") == "assistant", "tool.execution.acknowledged")
        .otherwise("agent.intent.recorded")
        .alias("event_type"),
        F.timestamp_micros(
            F.lit(1_704_067_200_000_000) + F.col("conv_id") * 3_600_000_000 + F.col("turn") * 1_000_000
        ).alias("occurred_at"),
        F.timestamp_micros(
            F.lit(1_704_067_200_500_000) + F.col("conv_id") * 3_600_000_000 + F.col("turn") * 1_000_000
        ).alias("observed_at"),
        F.concat(F.lit("trace_"), F.col("conv_id")).alias("trace_id"),
        F.concat(F.lit("run_"), F.col("conv_id")).alias("run_id"),
        F.lit(None).cast("string").alias("span_id"),
        F.lit(None).cast("string").alias("session_id"),
        F.col("turn").alias("sequence"),
        F.when(F.col("turn") > 0, F.concat_ws("_", F.lit("msg"), "conv_id", F.col("turn") - 1)).alias(
            "parent_event_id"
        ),
        F.concat(F.lit("msg_"), F.col("conv_id"), F.lit("_0")).alias("root_event_id"),
        F.lit("chat").alias("source_component"),
        F.lit("chat_1").alias("source_instance_id"),
        F.lit("1").alias("source_version"),
        F.col("role").alias("principal_id"),
        F.when(F.col("role") == "user", "human").otherwise("model").alias("principal_type"),
        F.lit("internal").alias("sensitivity"),
        F.lit("local").alias("trust"),
        F.try_parse_json(
            F.to_json(F.struct(F.col("role").alias("role"), F.col("text").alias("text"), "turn"))
        ).alias("payload_v"),
    )
