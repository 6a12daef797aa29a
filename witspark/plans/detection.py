"""Sequence detection queries over `events`."""

from pyspark.sql import functions as F

from witspark.functions.payload import Resolver
from witspark.functions.predicates import predicate
from witspark.operators import detect
from witspark.operators.rules import STARTER, VALIDATION, Rule, Stage
from witspark.plans.registry import query
from witspark.sources.tables import flat_events

BY_TRACE = ("correlation.trace_id",)

ACK_SEND = {"tool_identity.name": "safe_http.send"}


def sequence_sql(rules, suppression=None, hits=None) -> str:
    """Greedy matching of (rule id, group column, [stage conditions], window seconds) in SQL.

    `hits` may give the matching events of all rules in SQL instead.
    """

    hits = hits or " UNION ALL ".join(
        f"SELECT '{rule_id}' AS rule_id, {len(stages)} AS k, {within or 'NULL'}::DOUBLE AS win,"
        f" {group} AS g, event_id, occurred_at, n, ("
        + " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(stages))
        + ") AS mask FROM evp"
        for rule_id, group, stages, within in rules
    )
    text = f"""WITH RECURSIVE {{EV}}, hits AS ({hits}),
    h AS (SELECT *, row_number() OVER (PARTITION BY rule_id, g ORDER BY occurred_at, n) AS rn
      FROM hits WHERE mask > 0),
    f AS (SELECT DISTINCT rule_id, g, k, win, 0::BIGINT AS rn, 0 AS stage, '' AS ids,
      NULL::TIMESTAMP AS first_at, '' AS done, NULL::TIMESTAMP AS done_first,
      NULL::TIMESTAMP AS done_last FROM h
    UNION ALL
    SELECT s.rule_id, s.g, s.k, s.win, s.rn, CASE WHEN hit THEN (stage + 1) % s.k ELSE stage END,
      CASE WHEN NOT hit THEN ids WHEN stage = s.k - 1 THEN '' ELSE ids || s.event_id || ',' END,
      CASE WHEN hit AND stage = 0 THEN s.occurred_at ELSE first_at END,
      CASE WHEN hit AND stage = s.k - 1 THEN ids || s.event_id ELSE '' END,
      CASE WHEN stage = 0 THEN s.occurred_at ELSE first_at END, s.occurred_at
    FROM (SELECT h.*, f.stage, f.ids, f.first_at, ((h.mask >> f.stage) & 1) = 1 AS hit
      FROM f JOIN h ON h.rule_id = f.rule_id AND h.g = f.g AND h.rn = f.rn + 1) s),
    m AS (SELECT rule_id, g, done AS ids, done_first, done_last FROM f WHERE done <> ''
      AND (win IS NULL OR k = 1 OR epoch_us(done_last) - epoch_us(done_first) <= win * 1000000))"""
    if suppression is None:
        return text + " SELECT rule_id, g AS grp, ids FROM m"
    return (
        text
        + f""", o AS (SELECT *, row_number() OVER (PARTITION BY rule_id, g ORDER BY done_first) AS mn FROM m),
    u AS (SELECT rule_id, g, mn, ids, true AS kept, done_first AS last_at FROM o WHERE mn = 1
    UNION ALL SELECT o.rule_id, o.g, o.mn, o.ids,
      epoch_us(o.done_first) - epoch_us(u.last_at) > {suppression * 1_000_000},
      CASE WHEN epoch_us(o.done_first) - epoch_us(u.last_at) > {suppression * 1_000_000}
        THEN o.done_first ELSE u.last_at END
      FROM u JOIN o ON o.rule_id = u.rule_id AND o.g = u.g AND o.mn = u.mn + 1)
    SELECT rule_id, g AS grp, ids FROM u WHERE kept"""
    )


def shown(matches):
    return matches.select(
        "rule_id",
        F.array_join("group_key", ",").alias("grp"),
        F.array_join("event_ids", ",").alias("ids"),
    )


def _tool(name):
    return f"event_type = 'tool.execution.acknowledged' AND tool_name = '{name}'"


def _effect(kind, status):
    return f"event_type = 'side_effect.{kind}' AND has_link AND link_status = '{status}'"


# ---- grouping and paths


@query(
    "det_group_by_paths",
    """WITH {EV} SELECT trace_id || '|' || coalesce(tool_name, '') || '|' ||
    CASE WHEN flag THEN 'True' ELSE '' END || '|' || CASE WHEN k = 0 THEN '' ELSE CAST(k AS VARCHAR) END
    AS grp, count(*) AS events FROM ev GROUP BY 1""",
)
def group_by_paths(spark, sf_dir):
    paths = ("correlation.trace_id", "tool_identity.name", "flag", "k")
    keyed = detect.group_keys(flat_events(spark, sf_dir), paths)
    return keyed.groupBy(F.array_join("group_key", "|").alias("grp")).agg(
        F.count(F.lit(1)).alias("events")
    )


@query(
    "det_path_resolve",
    """WITH {EV} SELECT event_id, coalesce(sens_resource, '') AS listed,
    coalesce(link_observer, '') AS nested, trace_id AS envelope, '' AS absent FROM ev""",
)
def path_resolve(spark, sf_dir):
    find = Resolver()
    return flat_events(spark, sf_dir).select(
        "event_id",
        find.text("action.resources.0.attributes.sensitivity").alias("listed"),
        find.text("payload.evidence_link.observer_identity").alias("nested"),
        find.text("correlation.trace_id").alias("envelope"),
        find.text("action.resources.7.attributes").alias("absent"),
    )


# ---- predicates: name, path, expectation, SQL condition

_PREDICATES = (
    ("det_pred_eq", "tool_identity.name", "safe_files.read", "tool_name = 'safe_files.read'"),
    ("det_pred_in", "k", {"in": [3, 5, "7"]}, "k IN (3, 5)"),
    ("det_pred_exists", "resource.identifier", {"exists": False}, "resource_id IS NULL"),
    ("det_pred_prefix", "resource.identifier", {"prefix": "file:///data/1"}, "resource_id LIKE 'file:///data/1%'"),
    ("det_pred_suffix", "tool_identity.name", {"suffix": ".read"}, "tool_name LIKE '%.read'"),
    ("det_pred_regex", "resource.identifier", {"regex": r"/1\d\.txt$"}, "regexp_matches(resource_id, '/1[0-9]\\.txt$')"),
    ("det_pred_not", "tool_identity.name", {"not": "safe_http.send"}, "tool_name <> 'safe_http.send'"),
    ("det_pred_compare", "evidence_link.confidence", {"gte": 0.5}, "link_confidence >= 0.5"),
    ("det_pred_compare_time", "seen_at", {"lt": "2024-01-10T00:00:00Z"}, "occurred_at < TIMESTAMP '2024-01-10'"),
    ("det_pred_envelope", "classification.trust", {"in": ["trusted", "local"]}, "trust IN ('trusted', 'local')"),
    ("det_pred_compare_text", "label", {"gt": 3}, "false"),
)


def _register(name, path, expected, condition):
    @query(name, f"WITH {{EV}} SELECT event_id, {condition} AND true AS hit FROM ev WHERE {condition}"
           if condition != "false" else "WITH {EV} SELECT event_type, 0::BIGINT AS hits FROM ev GROUP BY 1")
    def run(spark, sf_dir):
        events = flat_events(spark, sf_dir)
        hit = predicate(Resolver(), path, expected)
        if condition == "false":
            return events.groupBy("event_type").agg(F.count_if(hit).alias("hits"))
        return events.withColumn("hit", hit).filter("hit").select("event_id", "hit")


for _spec in _PREDICATES:
    _register(*_spec)


STAGED = Rule(
    "staged",
    "staged",
    (
        Stage("tool.execution.acknowledged", {**ACK_SEND, "acknowledgement.status": {"in": ["success"]}}),
        Stage("side_effect.unverified", {"evidence_link.confidence": {"lt": 0.6}}),
    ),
)


@query(
    "det_stage_match",
    """WITH {EV}, m AS (SELECT event_id, (CASE WHEN event_type = 'tool.execution.acknowledged'
    AND tool_name = 'safe_http.send' AND ack_status = 'success' THEN 1 ELSE 0 END
    + CASE WHEN event_type = 'side_effect.unverified' AND link_confidence < 0.6 THEN 2 ELSE 0 END)::BIGINT
    AS mask FROM ev) SELECT * FROM m WHERE mask > 0""",
)
def stage_match(spark, sf_dir):
    events = flat_events(spark, sf_dir)
    return events.select("event_id", detect.stage_mask(STAGED, Resolver())[0].alias("mask")).filter(
        "mask > 0"
    )


# ---- sequences

FUNNEL = ("agent.run.started", "tool.execution.acknowledged", "side_effect.verified")
FUNNEL_SQL = [f"event_type = '{t}'" for t in FUNNEL]


def funnel(**options):
    return Rule("funnel", "funnel", tuple(Stage(t) for t in FUNNEL), group_by=BY_TRACE, **options)


@query("det_seq_ordered", sequence_sql([("funnel", "trace_id", FUNNEL_SQL, None)]))
def seq_ordered(spark, sf_dir):
    return shown(detect.evaluate_rules(flat_events(spark, sf_dir), [funnel()]))


@query("det_seq_within", sequence_sql([("funnel", "trace_id", FUNNEL_SQL, 86400)]))
def seq_within(spark, sf_dir):
    return shown(detect.evaluate_rules(flat_events(spark, sf_dir), [funnel(within_seconds=86400.0)]))


ANY_ORDER = Rule(
    "any_order",
    "any order",
    (Stage("side_effect.verified"), Stage("agent.run.started"), Stage("side_effect.verified")),
    group_by=BY_TRACE,
    ordered=False,
    within_seconds=864000.0,
)


@query(
    "det_seq_unordered",
    """WITH {EV}, s AS (SELECT trace_id, event_type, event_id, occurred_at,
    row_number() OVER (PARTITION BY trace_id, event_type ORDER BY occurred_at, n) AS rn FROM ev),
    p AS (SELECT trace_id,
      max(CASE WHEN event_type = 'side_effect.verified' AND rn = 1 THEN event_id END) AS a,
      max(CASE WHEN event_type = 'agent.run.started' AND rn = 1 THEN event_id END) AS b,
      max(CASE WHEN event_type = 'side_effect.verified' AND rn = 2 THEN event_id END) AS c,
      max(CASE WHEN (event_type = 'side_effect.verified' AND rn <= 2) OR
        (event_type = 'agent.run.started' AND rn = 1) THEN occurred_at END) AS hi,
      min(CASE WHEN (event_type = 'side_effect.verified' AND rn <= 2) OR
        (event_type = 'agent.run.started' AND rn = 1) THEN occurred_at END) AS lo
      FROM s GROUP BY trace_id)
    SELECT 'any_order' AS rule_id, trace_id AS grp, a || ',' || b || ',' || c AS ids FROM p
    WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL
    AND epoch_us(hi) - epoch_us(lo) <= 864000000000""",
)
def seq_unordered(spark, sf_dir):
    return shown(detect.evaluate_rules(flat_events(spark, sf_dir), [ANY_ORDER]))


@query("det_seq_dedupe", sequence_sql([("funnel", "trace_id", FUNNEL_SQL[1:], None)]))
def seq_dedupe(spark, sf_dir):
    """The same events twice, one microsecond apart: repeats of one id pair drop out."""
    rule = Rule("funnel", "funnel", tuple(Stage(t) for t in FUNNEL[1:]), group_by=BY_TRACE)
    events = flat_events(spark, sf_dir)
    twice = detect.evaluate_rules(events, [rule]).unionByName(
        detect.evaluate_rules(events, [rule])
    )
    keyed = twice.select(
        F.lit(0).alias("rule_no"),
        F.to_json("group_key").alias("group_key"),
        "event_ids",
        "first_us",
        "last_us",
        F.lit("").alias("suppression"),
    )
    once = detect.deduplicate(keyed)
    return shown(
        once.select(
            F.lit("funnel").alias("rule_id"),
            F.from_json("group_key", "array<string>").alias("group_key"),
            "event_ids",
        )
    )


@query(
    "det_seq_suppress",
    sequence_sql([("quiet", "trace_id", ["event_type LIKE 'agent.run.started'"], None)], 172800),
)
def seq_suppress(spark, sf_dir):
    rule = Rule(
        "quiet",
        "quiet",
        (Stage("agent.run.started"),),
        group_by=BY_TRACE,
        suppression_seconds=172800.0,
    )
    return shown(detect.evaluate_rules(flat_events(spark, sf_dir), [rule]))


MIXED = (
    funnel(),
    Rule(
        "send_unverified",
        "send without effect",
        (
            Stage("tool.execution.acknowledged", ACK_SEND),
            Stage("side_effect.unverified", {"evidence_link.verification_status": "unverified"}),
        ),
        group_by=BY_TRACE,
        within_seconds=432000.0,
    ),
    Rule("skipped", "filtered out by id", (Stage("policy.decision"),)),
)
MIXED_SQL = [
    ("funnel", "trace_id", FUNNEL_SQL, None),
    ("send_unverified", "trace_id", [_tool("safe_http.send"), _effect("unverified", "unverified")], 432000),
]


@query("det_multi_rule_evaluate", sequence_sql(MIXED_SQL))
def multi_rule(spark, sf_dir):
    return shown(
        detect.evaluate_rules(
            flat_events(spark, sf_dir), MIXED, rule_ids={"funnel", "send_unverified"}
        )
    )


def many_rules(n=2000):
    """Rules of two stages that differ in the values they want, some by lists, flags or comparisons."""
    ack, effect = "tool.execution.acknowledged", "side_effect.verified"
    return [
        Rule(
            f"r{i}",
            f"rule {i}",
            (
                Stage(ack, {"k": {"in": [i % 80, (i * 3 + 1) % 80]}}),
                Stage(effect, {"k": i * 7 % 80, "flag": i % 2 == 0} if i % 4 else {"k": {"gte": 60 + i % 20}}),
            ),
            group_by=BY_TRACE,
        )
        for i in range(n)
    ]


_MANY_HITS = """SELECT 'r' || i AS rule_id, 2 AS k, NULL::DOUBLE AS win, trace_id AS g, event_id, occurred_at, n,
    CASE WHEN event_type = 'side_effect.verified' THEN 2 ELSE 1 END AS mask FROM evp JOIN generate_series(0, 1999) r(i)
    ON (event_type = 'tool.execution.acknowledged' AND k IN (i % 80, (i * 3 + 1) % 80))
    OR (event_type = 'side_effect.verified' AND CASE WHEN i % 4 > 0 THEN k = i * 7 % 80 AND flag = (i % 2 = 0)
      ELSE k >= 60 + i % 20 END)"""


@query("det_rule_index", sequence_sql([], hits=_MANY_HITS))
def rule_index(spark, sf_dir):
    """Two thousand rules in one plan."""
    return shown(detect.evaluate_rules(flat_events(spark, sf_dir), many_rules()))


@query(
    "det_rule_explain",
    """WITH {EV} SELECT trace_id AS grp, count(*) AS event_count, s.i::BIGINT AS stage_index, s.t AS event_type,
    count_if(ev.event_type = s.t) AS candidates
    FROM ev, (VALUES (0, 'agent.run.started'), (1, 'tool.execution.acknowledged'),
    (2, 'side_effect.verified')) s(i, t) GROUP BY trace_id, s.i, s.t""",
)
def rule_explain(spark, sf_dir):
    rows = detect.explain_rule(flat_events(spark, sf_dir), funnel())
    return rows.select(
        F.array_join("group_key", ",").alias("grp"),
        "event_count",
        F.col("stage_index").cast("bigint").alias("stage_index"),
        "event_type",
        "candidates",
    )


_NOT_SENT = "event_type = 'tool.execution.not_dispatched' AND NOT forwarded"
_PACK_SQL = [
    (
        "starter.restricted_read_then_verified_send",
        "run_id",
        ["event_type = 'action.normalized' AND sens_resource = 'restricted'", _effect("verified", "verified")],
        None,
    ),
    (
        "starter.descriptor_drift_then_action",
        "run_id",
        ["event_type = 'agent.tool.schema_changed'", "event_type = 'action.normalized'"],
        None,
    ),
    (
        "starter.acknowledged_not_observed",
        "run_id",
        [
            _tool("safe_http.send") + " AND ack_status IN ('success', 'succeeded')",
            "event_type = 'side_effect.unverified' AND has_link AND link_status IN ('unverified', 'timed_out')",
        ],
        None,
    ),
    ("starter.conflicting_evidence", "run_id", ["event_type = 'side_effect.conflict_detected'"], None),
    (
        "starter.policy_failure_before_dispatch",
        "run_id",
        ["event_type = 'policy.decision' AND outcome IN ('deny', 'error')", _NOT_SENT],
        None,
    ),
    ("validation.verified_read", "run_id", [_tool("safe_files.read"), _effect("verified", "verified")], None),
    (
        "validation.acknowledged_then_timeout",
        "run_id",
        [_tool("safe_http.send"), _effect("timed_out", "timed_out")],
        None,
    ),
    (
        "validation.denied_not_dispatched",
        "run_id",
        ["event_type = 'policy.decision' AND outcome = 'deny'", _NOT_SENT],
        None,
    ),
    (
        "validation.drift_then_conflict",
        "run_id",
        ["event_type = 'agent.tool.schema_changed'", _effect("conflict_detected", "conflicting")],
        None,
    ),
    (
        "validation.read_then_send_unverified",
        "run_id",
        [
            _tool("safe_files.read"),
            _effect("verified", "verified"),
            _tool("safe_http.send"),
            _effect("unverified", "unverified"),
        ],
        None,
    ),
    (
        "validation.denied_then_alternative",
        "run_id",
        [
            "event_type = 'policy.decision' AND outcome = 'deny'",
            _NOT_SENT,
            _tool("safe_http.send"),
            _effect("unverified", "unverified"),
        ],
        None,
    ),
]


@query("det_rule_packs", sequence_sql(_PACK_SQL))
def rule_packs(spark, sf_dir):
    return shown(detect.evaluate_rules(flat_events(spark, sf_dir), STARTER + VALIDATION))


@query(
    "det_alert_rows",
    sequence_sql(MIXED_SQL).replace(
        " SELECT rule_id, g AS grp, ids FROM m",
        " SELECT rule_id, g AS grp, unnest(string_split(ids, ',')) AS event_id,"
        " generate_subscripts(string_split(ids, ','), 1) - 1 AS stage_index FROM m",
    ),
)
def alert_rows(spark, sf_dir):
    rows = detect.alert_rows(detect.evaluate_rules(flat_events(spark, sf_dir), MIXED[:2]))
    return rows.select(
        "rule_id",
        F.array_join("group_key", ",").alias("grp"),
        "event_id",
        F.col("stage_index").cast("bigint").alias("stage_index"),
    )


@query(
    "det_explain_candidates",
    "WITH {EV} "
    + " UNION ALL ".join(
        f"SELECT trace_id AS grp, event_id, {i}::BIGINT AS stage_index FROM ev WHERE {condition}"
        for i, condition in enumerate(FUNNEL_SQL)
    ),
)
def explain_candidates(spark, sf_dir):
    """Every event that some stage of the funnel could take."""
    return detect.explain_candidates(flat_events(spark, sf_dir), funnel()).select(
        F.array_join("group_key", ",").alias("grp"), "event_id", F.col("stage_index").cast("bigint").alias("stage_index")
    )
