"""Contract queries over `events`, one scope per trace, and over the journals."""

from pyspark.sql import functions as F

from witspark.operators import contract as C, detect, integrity as I
from witspark.operators.rules import Rule, Stage
from witspark.plans.integrity import CHAIN, lines, tampered
from witspark.plans.registry import query
from witspark.sources.tables import evidence_events

BY = ["trace_id"]


def events(spark, sf_dir):
    return evidence_events(spark, sf_dir).withColumn("payload_v", F.try_parse_json("payload"))


def shown(df, by=BY):
    return df.select(*by, *[F.coalesce(c, F.lit("")).alias(c) for c in C.SHAPE])


_TRACES = "tr AS (SELECT DISTINCT trace_id FROM evp)"


def _row(code, event_id="''", event_type="''", field="''"):
    return f"trace_id, '{code}' AS code, {event_id} AS event_id, {event_type} AS event_type, {field} AS field"


@query(
    "con_c_integrity",
    f"""{CHAIN}, s AS (SELECT v1.*, ver.ok, ver.bad_at AS ba FROM v1 JOIN ver ON ver.journal_id = v1.journal_id)
    SELECT journal_id, CASE WHEN CAST(substring(journal_id, 9) AS BIGINT) % 11 = 0 THEN 'journal_integrity_unverified'
    WHEN NOT ok THEN 'journal_integrity_violation' ELSE 'journal_integrity_snapshot_mismatch' END AS code
    FROM s WHERE CAST(substring(journal_id, 9) AS BIGINT) % 11 = 0 OR NOT ok OR (kind = 3 AND n = 2)""",
)
def c_integrity(spark, sf_dir):
    """Events of the sound journals against verdicts on damaged ones; some verdicts lack."""
    number = F.regexp_extract("journal_id", "([0-9]+)", 1).cast("bigint")
    verdict = I.verify_chain(tampered(spark, sf_dir)).filter(number % 11 != 0)
    return C.check_integrity(lines(spark, sf_dir), verdict).select("journal_id", "code")


REQUIRED = C.Contract(
    "required",
    events=(
        C.EventRequirement("agent.tool.schema_changed", ("payload.tool_identity.name",)),
        C.EventRequirement("side_effect.timed_out", ("payload.evidence_link.limitations", "correlation.trace_id")),
        C.EventRequirement("agent.run.failed"),
    ),
    required_status="timed_out",
    allowed_statuses=("verified", "observed", "unverified", "timed_out"),
)


def _presence(spark, sf_dir, code):
    rows = C.check_presence(events(spark, sf_dir), REQUIRED, BY)
    return shown(rows.filter(F.col("code") == code))


@query(
    "con_c_required_event",
    f"""WITH {{EV}}, {_TRACES}, t AS (SELECT unnest(['agent.tool.schema_changed', 'side_effect.timed_out',
    'agent.run.failed']) AS kind) SELECT {_row('required_event_missing', event_type='kind')} FROM tr, t
    WHERE NOT EXISTS (SELECT 1 FROM evp WHERE evp.trace_id = tr.trace_id AND evp.event_type = kind)""",
)
def c_required_event(spark, sf_dir):
    return _presence(spark, sf_dir, "required_event_missing")


@query(
    "con_c_required_field",
    f"""WITH {{EV}}, a AS (SELECT trace_id,
    bool_or(event_type = 'agent.tool.schema_changed') AS e0,
    bool_or(event_type = 'agent.tool.schema_changed' AND tool_name IS NOT NULL) AS f0,
    bool_or(event_type = 'side_effect.timed_out') AS e1,
    bool_or(event_type = 'side_effect.timed_out' AND has_link AND limit_text <> '') AS f1 FROM evp GROUP BY trace_id)
    SELECT {_row('required_field_missing', event_type="'agent.tool.schema_changed'", field="'payload.tool_identity.name'")}
    FROM a WHERE e0 AND NOT f0 UNION ALL
    SELECT {_row('required_field_missing', event_type="'side_effect.timed_out'", field="'payload.evidence_link.limitations'")}
    FROM a WHERE e1 AND coalesce(NOT f1, true)""",
)
def c_required_field(spark, sf_dir):
    return _presence(spark, sf_dir, "required_field_missing")


_STATUS_FIELD = "'payload.evidence_link.verification_status'"


@query(
    "con_c_status_required",
    f"""WITH {{EV}}, a AS (SELECT trace_id, bool_or(coalesce(link_status, '') = 'timed_out' OR
    coalesce(top_status, '') = 'timed_out') AS there FROM evp GROUP BY trace_id)
    SELECT {_row('verification_status_missing', field=_STATUS_FIELD)} FROM a WHERE NOT there""",
)
def c_status_required(spark, sf_dir):
    return _presence(spark, sf_dir, "verification_status_missing")


@query(
    "con_c_status_allowed",
    f"""WITH {{EV}}, s AS (SELECT trace_id, link_status AS s FROM evp UNION SELECT trace_id, top_status FROM evp)
    SELECT {_row('verification_status_not_allowed', field='s')} FROM s
    WHERE nullif(s, '') IS NOT NULL AND s NOT IN ('verified', 'observed', 'unverified', 'timed_out')""",
)
def c_status_allowed(spark, sf_dir):
    return shown(C.check_allowed_statuses(events(spark, sf_dir), REQUIRED, BY))


BY_PARENT = C.Relationship("side_effect.verified", "tool.execution.acknowledged")
BY_SUBJECT = C.Relationship(
    "side_effect.verified", "tool.execution.requested", "payload.evidence_link.subject_event_id"
)


@query(
    "con_c_relationship",
    f"""WITH {{EV}}, {_TRACES} SELECT {_row('relationship_missing', event_type="'side_effect.verified'")} FROM tr
    WHERE NOT EXISTS (SELECT 1 FROM evp c JOIN evp p ON p.trace_id = c.trace_id AND p.event_id = c.parent_event_id
    WHERE c.trace_id = tr.trace_id AND c.event_type = 'side_effect.verified'
    AND p.event_type = 'tool.execution.acknowledged') UNION ALL
    SELECT {_row('relationship_missing', event_type="'side_effect.verified'",
                 field="'payload.evidence_link.subject_event_id'")} FROM tr
    WHERE NOT EXISTS (SELECT 1 FROM evp c JOIN evp p ON p.trace_id = c.trace_id AND p.event_id = c.subject
    WHERE c.trace_id = tr.trace_id AND c.event_type = 'side_effect.verified' AND c.has_link
    AND p.event_type = 'tool.execution.requested')""",
)
def c_relationship(spark, sf_dir):
    df = events(spark, sf_dir)
    return shown(
        C.check_relationship(df, BY_PARENT, BY).unionByName(C.check_relationship(df, BY_SUBJECT, BY))
    )


# Links may point anywhere in the table, so their scope is one value for all events.
LINKS = C.LinkRequirement(
    "side_effect.verified",
    subject_type="tool.execution.acknowledged",
    evidence_type="side_effect.observed",
    relationship="corroborates",
    status="verified",
    corroboration_types=("independent_observer", "post_action_readback"),
    observer="observer_1",
)


def _links(spark, sf_dir, code, event_type="side_effect.verified"):
    df = events(spark, sf_dir).withColumn("tenant", F.lit("all"))
    need = LINKS if event_type == LINKS.event_type else C.LinkRequirement(event_type)
    return shown(C.check_links(df, need, ["tenant"]).filter(F.col("code") == code), ["tenant"])


_LINKED = """l AS (SELECT e.*, s.event_type AS sk, p.event_type AS pk FROM evp e
 LEFT JOIN evp s ON s.event_id = e.subject LEFT JOIN evp p ON p.event_id = e.evidence
 WHERE e.event_type = 'side_effect.verified')"""


def _link_row(code, field="'payload.evidence_link'"):
    return f"'all' AS tenant, '{code}' AS code, event_id, event_type, {field} AS field"


@query(
    "con_c_link_event_missing",
    f"""WITH {{EV}}, {_TRACES} SELECT {_row('evidence_link_event_missing', event_type="'side_effect.timed_out'")}
    FROM tr WHERE NOT EXISTS (SELECT 1 FROM evp WHERE evp.trace_id = tr.trace_id
    AND event_type = 'side_effect.timed_out')""",
)
def c_link_event_missing(spark, sf_dir):
    rows = C.check_links(events(spark, sf_dir), C.LinkRequirement("side_effect.timed_out"), BY)
    return shown(rows.filter("code = 'evidence_link_event_missing'"))


@query(
    "con_c_link_missing",
    f"WITH {{EV}}, {_LINKED} SELECT {_link_row('evidence_link_missing')} FROM l WHERE NOT has_link",
)
def c_link_missing(spark, sf_dir):
    return _links(spark, sf_dir, "evidence_link_missing")


@query(
    "con_c_link_field_missing",
    f"WITH {{EV}}, {_LINKED} SELECT {_link_row('evidence_link_field_missing')} FROM l WHERE has_link"
    " AND (subject IS NULL OR evidence IS NULL)",
)
def c_link_field_missing(spark, sf_dir):
    return _links(spark, sf_dir, "evidence_link_field_missing")


@query(
    "con_c_link_reference_missing",
    f"WITH {{EV}}, {_LINKED} SELECT {_link_row('evidence_link_reference_missing')} FROM l WHERE has_link"
    " AND subject IS NOT NULL AND evidence IS NOT NULL AND (sk IS NULL OR pk IS NULL)",
)
def c_link_reference_missing(spark, sf_dir):
    return _links(spark, sf_dir, "evidence_link_reference_missing")


_SOUND = "has_link AND sk IS NOT NULL AND pk IS NOT NULL"
_MISMATCHES = (
    ("subjectEventType", "sk <> 'tool.execution.acknowledged'"),
    ("evidenceEventType", "pk <> 'side_effect.observed'"),
    ("relationship", "link_relationship <> 'corroborates'"),
    ("verificationStatus", "link_status IS DISTINCT FROM 'verified'"),
    ("observerIdentity", "link_observer <> 'observer_1'"),
    ("corroboration_type", "link_corroboration NOT IN ('independent_observer', 'post_action_readback')"),
)


def _mismatch_sql(name, test):
    field = f"'payload.evidence_link.{name}'"
    row = _link_row("evidence_link_requirement_mismatch", field)
    return f"SELECT {row} FROM l WHERE {_SOUND} AND {test}"


@query(
    "con_c_link_mismatch",
    f"WITH {{EV}}, {_LINKED} " + " UNION ALL ".join(_mismatch_sql(n, t) for n, t in _MISMATCHES),
)
def c_link_mismatch(spark, sf_dir):
    return _links(spark, sf_dir, "evidence_link_requirement_mismatch")


NEAR = C.Latency(
    "agent.tool.schema_changed", "tool.execution.acknowledged", 43200.0, ("correlation.run_id",)
)


@query(
    "con_c_latency",
    f"""WITH {{EV}}, st AS (SELECT * FROM evp WHERE event_type = 'agent.tool.schema_changed'),
    en AS (SELECT * FROM evp WHERE event_type = 'tool.execution.acknowledged'), {_TRACES},
    gap AS (SELECT en.trace_id, en.event_id, en.event_type, (SELECT min(abs(epoch_us(en.occurred_at) - epoch_us(st.occurred_at)))
    FROM st WHERE st.trace_id = en.trace_id AND st.run_id = en.run_id) AS us FROM en
    WHERE en.trace_id IN (SELECT trace_id FROM st))
    SELECT {_row('latency_start_missing', 'event_id', 'event_type')} FROM gap WHERE us IS NULL UNION ALL
    SELECT {_row('latency_breach', 'event_id', 'event_type', "'occurred_at'")} FROM gap WHERE us > 43200000000 UNION ALL
    SELECT {_row('latency_event_missing', event_type="'tool.execution.acknowledged'")} FROM tr
    WHERE trace_id NOT IN (SELECT trace_id FROM st) OR trace_id NOT IN (SELECT trace_id FROM en)""",
)
def c_latency(spark, sf_dir):
    return shown(C.check_latency(events(spark, sf_dir), NEAR, BY))


@query(
    "con_c_descriptor",
    f"""WITH {{EV}}, {_TRACES}, d AS (SELECT * FROM evp WHERE event_type = 'policy.decision')
    SELECT {_row('descriptor_event_missing', event_type="'policy.decision'")} FROM tr
    WHERE trace_id NOT IN (SELECT trace_id FROM d) UNION ALL
    SELECT {_row('descriptor_identity_missing', 'event_id', 'event_type', "'payload.tool_identity.descriptor_hash'")}
    FROM d WHERE tool_name IS NULL UNION ALL
    SELECT {_row('descriptor_hash_invalid', 'event_id', 'event_type', "'payload.tool_identity.descriptor_hash'")}
    FROM d WHERE descriptor_hash LIKE 'md5:%'""",
)
def c_descriptor(spark, sf_dir):
    return shown(C.check_descriptor(events(spark, sf_dir), C.Descriptor("policy.decision"), BY))


DRIFT = Rule(
    "drift",
    "drift then action",
    (Stage("agent.tool.schema_changed"), Stage("action.normalized")),
    group_by=("correlation.trace_id",),
)
NEED = C.DetectionRequirement("drift", True, ("side_effect.timed_out",), ("conflicting",))


@query(
    "con_c_detection",
    f"""WITH {{EV}}, a AS (SELECT trace_id, min(CASE WHEN event_type = 'agent.tool.schema_changed' THEN occurred_at END) AS first_drift,
    max(CASE WHEN event_type = 'action.normalized' THEN occurred_at END) AS last_action,
    bool_or(event_type = 'side_effect.timed_out') AS t,
    bool_or(coalesce(link_status, '') = 'conflicting' OR coalesce(top_status, '') = 'conflicting') AS s FROM evp GROUP BY trace_id),
    h AS (SELECT *, coalesce(first_drift < last_action, false) AS hit FROM a)
    SELECT {_row('required_detection_missing')} FROM h WHERE NOT hit UNION ALL
    SELECT {_row('detection_control_dependency_missing')} FROM h WHERE hit AND NOT t UNION ALL
    SELECT {_row('detection_control_dependency_missing', field=_STATUS_FIELD)} FROM h WHERE hit AND NOT s""",
)
def c_detection(spark, sf_dir):
    df = events(spark, sf_dir)
    matches = detect.evaluate_rules(df, [DRIFT]).select(
        F.col("group_key")[0].alias("trace_id"), "rule_id"
    )
    return shown(C.check_detection(df, matches, NEED, BY))


@query(
    "con_contract_validate",
    f"""WITH {{EV}}, {_TRACES}, d AS (SELECT * FROM evp WHERE event_type = 'policy.decision'),
    s AS (SELECT trace_id, link_status AS s FROM evp UNION SELECT trace_id, top_status FROM evp),
    v AS (SELECT trace_id, 'calls' AS contract, 'required_event_missing' AS code FROM tr WHERE NOT EXISTS
      (SELECT 1 FROM evp WHERE evp.trace_id = tr.trace_id AND event_type = 'side_effect.timed_out') UNION ALL
    SELECT trace_id, 'calls', 'verification_status_not_allowed' FROM s WHERE nullif(s, '') IS NOT NULL AND s <> 'verified' UNION ALL
    SELECT trace_id, 'policy', 'descriptor_event_missing' FROM tr WHERE trace_id NOT IN (SELECT trace_id FROM d) UNION ALL
    SELECT trace_id, 'policy', 'descriptor_identity_missing' FROM d WHERE tool_name IS NULL UNION ALL
    SELECT trace_id, 'policy', 'descriptor_hash_invalid' FROM d WHERE descriptor_hash LIKE 'md5:%')
    SELECT trace_id, contract, code, count(*) AS violations FROM v GROUP BY ALL""",
)
def contract_validate(spark, sf_dir):
    contracts = (
        C.Contract(
            "calls",
            events=(C.EventRequirement("side_effect.timed_out"),),
            allowed_statuses=("verified",),
        ),
        C.Contract("policy", descriptors=(C.Descriptor("policy.decision"),)),
    )
    rows = C.validate(events(spark, sf_dir), contracts, BY)
    return rows.groupBy("trace_id", "contract", "code").agg(F.count(F.lit(1)).alias("violations"))
