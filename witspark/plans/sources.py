"""Source, parsing and validation queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from witspark import schema as S
from witspark.functions.times import canonical_ts, to_utc
from witspark.operators import validate as V
from witspark.plans.integrity import CHAIN, chained
from witspark.plans.lineage import shared_folder
from witspark.plans.projection import SEEN
from witspark.plans.registry import query
from witspark.sources.journal import dealt_by_files, read_journal, scan_artifacts, write_ndjson
from witspark.sources.tables import event_line, flat_events, table


def journal_files(spark, sf_dir):
    """All journals written as one newline-delimited file each."""
    folder = f"{shared_folder(spark)}/journals-{uuid.uuid4().hex[:12]}"
    rows = chained(spark, sf_dir)
    (
        dealt_by_files(rows, rows.select("journal_id").distinct().count(), "journal_id")
        .sortWithinPartitions("journal_id", "record_number")
        .select("journal_id", F.col("line").alias("value"))
        .write.partitionBy("journal_id")
        .option("lineSep", "\n")
        .text(folder)
    )
    return folder


def _journal(col):
    return F.regexp_extract(col, r"journal_id=([^/]+)/", 1)


@query(
    "src_journal_scan",
    f"{CHAIN} SELECT journal_id, record_number, sha256(line) AS digest, true AS terminated FROM ln",
)
def journal_scan(spark, sf_dir):
    rows = read_journal(spark, journal_files(spark, sf_dir))
    return rows.select(
        _journal("journal_id").alias("journal_id"),
        "record_number",
        F.sha2("line", 256).alias("digest"),
        "terminated",
    )


@query(
    "src_binary_artifact_scan",
    f"""{CHAIN} SELECT journal_id, sum(octet_length(encode(line)) + 1)::BIGINT AS size_bytes, 'sha256:' ||
    sha256(string_agg(line || chr(10), '' ORDER BY record_number)) AS sha256 FROM ln GROUP BY journal_id""",
)
def artifact_scan(spark, sf_dir):
    files = scan_artifacts(spark, journal_files(spark, sf_dir), "*.txt")
    return files.select(_journal("path").alias("journal_id"), "size_bytes", "sha256")


# A fault per line by the remainder of k; the event's own causality may fail as well.
_FAULTS = (
    (0, "unknown_field", lambda line: F.regexp_replace(line, r"\}$", ',"zzz":1}')),
    (1, "missing:event_type", lambda line: F.regexp_replace(line, '"event_type":"[^"]*"', '"event_type":""')),
    (2, "invalid_timestamp:occurred_at", lambda line: F.regexp_replace(line, '("occurred_at":"[^"]*)Z"', '$1"')),
    (3, "invalid:trust", lambda line: F.regexp_replace(line, '"trust":"[^"]*"', '"trust":"maybe"')),
    (4, "invalid_json", lambda line: F.regexp_replace(line, "^\\{", '{"event_id":"x",')),
    (5, "invalid_json", lambda line: F.replace(line, F.lit('"payload":{'), F.lit('"payload":{"bad":NaN,'))),
    (6, "unknown_field:source", lambda line: F.replace(line, F.lit('"source":{'), F.lit('"source":{"extra":1,'))),
    (7, "invalid_sequence", lambda line: F.regexp_replace(line, '"sequence":[0-9]+', '"sequence":-1')),
    (8, "not_an_object:payload", lambda line: F.regexp_replace(line, '"payload":\\{.*\\},"principal"', '"payload":[1],"principal"')),
)
_OWN = (
    "CASE WHEN parent_event_id IS NULL AND event_type NOT IN ('agent.intent.recorded', 'agent.run.started',"
    " 'recorder.degraded') THEN 'parent_required' END"
)


@query(
    "src_envelope_parse",
    "WITH {EV} SELECT event_id, CASE k % 12 "
    + " ".join(f"WHEN {i} THEN '{code}'" for i, code, _ in _FAULTS)
    + f" ELSE {_OWN} END AS error, CASE WHEN k % 12 IN (4, 5) THEN NULL ELSE run_id END AS run_id FROM evc",
)
def envelope_parse(spark, sf_dir):
    df = event_line(flat_events(spark, sf_dir))
    line = F.col("line")
    for i, _code, damage in _FAULTS:
        line = F.when(F.col("k") % 12 == i, damage(F.col("line"))).otherwise(line)
    rows = df.select(F.col("event_id").alias("source_id"), line.alias("line"))
    return V.parse_events(rows).select(F.col("source_id").alias("event_id"), "error", "run_id")


@query(
    "src_envelope_causality_check",
    f"WITH {{EV}} SELECT event_id, CASE WHEN k % 7 = 0 AND event_type = 'agent.run.started' THEN 'root_must_be_self'"
    " WHEN parent_event_id IS NULL AND event_type NOT IN ('agent.intent.recorded', 'agent.run.started',"
    " 'recorder.degraded') THEN 'parent_required' END AS violation FROM evc",
)
def causality_check(spark, sf_dir):
    """Every seventh start claims another root and no parent."""
    df = flat_events(spark, sf_dir, payload=False)
    wrong = (F.col("k") % 7 == 0) & (F.col("event_type") == "agent.run.started")
    df = df.withColumns(
        {
            "root_event_id": F.when(wrong, "elsewhere").otherwise(F.col("root_event_id")),
            "parent_event_id": F.when(~wrong, F.col("parent_event_id")),
        }
    )
    return V.check_causality(df).select("event_id", "violation")


@query(
    "src_timestamp_normalize",
    f"""WITH {{EV}} SELECT event_id, CASE WHEN k % 5 < 3 THEN epoch_us(occurred_at) END AS us,
    CASE WHEN k % 5 < 3 THEN {SEEN} END AS canonical FROM ev""",
)
def timestamp_normalize(spark, sf_dir):
    """Texts in UTC, with an offset, with a zero fraction, without a zone, and no time at all."""
    df = flat_events(spark, sf_dir, payload=False)
    at, k = F.col("occurred_at"), F.col("k")
    shifted = F.date_format(at + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = (
        F.when(k % 5 == 0, canonical_ts(at))
        .when(k % 5 == 1, F.concat(shifted, F.lit("+02:00")))
        .when(k % 5 == 2, F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00")))
        .when(k % 5 == 3, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise("yesterdayZ")
    )
    rows = df.select("event_id", to_utc(text).alias("t"))
    return rows.select("event_id", F.unix_micros("t").alias("us"), canonical_ts(F.col("t")).alias("canonical"))


def _flag(test):
    return f"CASE WHEN {test} THEN 1 ELSE 0 END"


_MEMBERS = " + ".join(
    ["5"]
    + [
        _flag(t)
        for t in (
            "tool_name IS NOT NULL",
            "resource_id IS NOT NULL",
            "ack_status IS NOT NULL",
            "outcome IS NOT NULL",
            "forwarded IS NOT NULL",
            "concurrent_child IS NOT NULL",
            "sens_resource IS NOT NULL",
            "top_status IS NOT NULL",
            "has_link",
        )
    ]
)
_LINK_MEMBERS = " + ".join(
    ["5"] + [_flag(t) for t in ("link_subject IS NOT NULL", "link_evidence IS NOT NULL", "link_status IS NOT NULL")]
)


@query(
    "src_json_limits_check",
    f"""WITH {{EV}} SELECT event_id, CASE WHEN sens_resource IS NOT NULL THEN 5 WHEN has_link AND limit_text <> '' THEN 3
    WHEN has_link OR tool_name IS NOT NULL OR resource_id IS NOT NULL OR ack_status IS NOT NULL OR forwarded IS NOT NULL
    OR concurrent_child IS NOT NULL THEN 2 ELSE 1 END::BIGINT AS max_depth,
    greatest({_MEMBERS}, CASE WHEN has_link THEN {_LINK_MEMBERS} ELSE 0 END)::BIGINT AS max_members,
    CASE WHEN sens_resource IS NOT NULL THEN 1 WHEN has_link THEN CASE limit_text WHEN '' THEN 0 WHEN 'local only' THEN 1
    ELSE 2 END ELSE 0 END::BIGINT AS max_array, true AS ok FROM ev""",
)
def json_limits(spark, sf_dir):
    return V.json_limits(flat_events(spark, sf_dir, payload=False), ["event_id"])


_KNOWN = ", ".join(f"'{t}'" for t in S.EVENT_TYPES)


@query(
    "src_compat_assess",
    f"""WITH {{EV}} SELECT event_id, CASE WHEN k % 9 = 0 THEN 'unsupported' WHEN event_type IN ({_KNOWN}) THEN 'supported_known'
    ELSE 'supported_unknown' END AS status, k % 9 <> 0 AS can_read, k % 9 <> 0 AND event_type IN ({_KNOWN}) AS can_interpret FROM ev""",
)
def compat_assess(spark, sf_dir):
    df = flat_events(spark, sf_dir, payload=False).withColumn(
        "spec_version", F.when(F.col("k") % 9 == 0, "other/v9").otherwise(F.col("spec_version"))
    )
    return V.assess_compat(df).select("event_id", "status", "can_read", "can_interpret")


@query(
    "src_collect_records",
    """SELECT 'order:' || o_orderkey AS idempotency_key, o_orderstatus AS status, NULL AS segment, 0::BIGINT AS source_ordinal FROM orders
    UNION ALL SELECT 'customer:' || c_custkey, NULL, c_mktsegment, 1 FROM customer
    UNION ALL SELECT 'page:' || page_id, NULL, NULL, 2 FROM pages""",
)
def collect_records(spark, sf_dir):
    def key(name, col):
        return F.concat(F.lit(f"{name}:"), F.col(col)).alias("idempotency_key")

    rows = V.collect_records(
        table(spark, sf_dir, "orders").select(key("order", "o_orderkey"), F.col("o_orderstatus").alias("status")),
        table(spark, sf_dir, "customer").select(key("customer", "c_custkey"), F.col("c_mktsegment").alias("segment")),
        table(spark, sf_dir, "pages").select(key("page", "page_id")),
    )
    return rows.withColumn("source_ordinal", F.col("source_ordinal").cast("bigint"))


@query(
    "exp_sink_ndjson",
    f"{CHAIN} SELECT sha256(line) AS digest FROM ln",
)
def sink_ndjson(spark, sf_dir):
    """Written as newline-delimited text and read back, every line keeps its bytes."""
    folder = f"{shared_folder(spark)}/ndjson-{uuid.uuid4().hex[:12]}"
    write_ndjson(chained(spark, sf_dir), folder)
    return read_journal(spark, folder).select(F.sha2("line", 256).alias("digest"))
