"""Queries over the flat projection of `events`."""

import uuid

from pyspark.sql import functions as F

from witspark.operators import graph, project
from witspark.operators.validate import parse_events
from witspark.plans.lineage import shared_folder
from witspark.plans.registry import query
from witspark.sources.tables import causal_events, event_line, evidence_events, flat_events

SEEN = (
    "strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(occurred_at) % 1000000 <> 0"
    " THEN '.' || lpad(CAST(epoch_us(occurred_at) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || 'Z'"
)
LIMITS = "CASE WHEN limit_text = '' THEN [] ELSE string_split(limit_text, '|') END"


def events(spark, sf_dir, flavour="a"):
    rows = evidence_events(spark, sf_dir)
    return rows if flavour == "a" else project.evidence_columns(rows, flavour)


def parsed(spark, sf_dir):
    lines = event_line(flat_events(spark, sf_dir)).select(
        "line", F.col("run_id").alias("journal_id"), (F.col("sequence") + 1).alias("record_number")
    )
    return parse_events(lines).withColumn(
        "event_hash", F.concat(F.lit("sha256:"), F.sha2("line", 256))
    )


_SHOWN = [
    "event_id",
    "event_type",
    "trace_id",
    "run_id",
    "root_event_id",
    "parent_event_id",
    "sequence",
    "verification_status",
    "evidence_subject_event_id",
    "evidence_event_id",
]


@query(
    "prj_project_events",
    """WITH {EV} SELECT event_id, event_type, trace_id, run_id, root_event_id, parent_event_id,
    sequence, status AS verification_status, subject AS evidence_subject_event_id,
    evidence AS evidence_event_id, epoch_us(occurred_at) AS occurred_us,
    sequence + 1 AS journal_record_number FROM evp""",
)
def project_events(spark, sf_dir):
    return project.project(parsed(spark, sf_dir)).select(
        *_SHOWN, F.unix_micros("occurred_at").alias("occurred_us"), "journal_record_number"
    )


@query(
    "prj_project_events_pg_variant",
    """WITH {EV} SELECT event_id, status_b AS verification_status,
    subject AS evidence_subject_event_id, evidence AS evidence_event_id,
    71::BIGINT AS digest_length FROM evp""",
)
def project_pg(spark, sf_dir):
    rows = project.project(parsed(spark, sf_dir), flavour="b")
    return rows.select(
        "event_id",
        "verification_status",
        "evidence_subject_event_id",
        "evidence_event_id",
        F.length("event_json_sha256").cast("bigint").alias("digest_length"),
    )


@query(
    "prj_projection_conflicts",
    """WITH {EV} SELECT event_id, CASE WHEN k % 10 = 2 THEN 3 ELSE 2 END::BIGINT AS copies,
    CASE WHEN k % 10 = 0 THEN 'no_op' ELSE 'conflict' END AS outcome
    FROM ev WHERE k % 10 < 3""",
)
def conflicts(spark, sf_dir):
    """Every event once, plus second copies: same, renumbered, and both."""
    rows = flat_events(spark, sf_dir).select(
        "event_id", "k", F.col("n").alias("journal_record_number"), F.col("payload").alias("event_json")
    )
    same = rows.filter("k % 10 IN (0, 2)")
    moved = rows.filter("k % 10 IN (1, 2)").withColumn(
        "journal_record_number", F.col("journal_record_number") + 1
    )
    return project.projection_conflicts(rows.union(same).union(moved))


@query(
    "prj_schema_upgrade",
    """WITH {EV} SELECT event_id, event_type, CAST(NULL AS VARCHAR) AS verification_status,
    CAST(NULL AS VARCHAR) AS evidence_subject_event_id,
    CAST(NULL AS VARCHAR) AS evidence_event_id FROM ev""",
)
def upgrade(spark, sf_dir):
    old = flat_events(spark, sf_dir, payload=False).select("event_id", "event_type")
    return project.upgrade_projection(old)


@query(
    "prj_timeline",
    """WITH {EV} SELECT trace_id, event_id, row_number() OVER (PARTITION BY trace_id
    ORDER BY occurred_at, n) AS position FROM ev""",
)
def timeline(spark, sf_dir):
    df = flat_events(spark, sf_dir, payload=False)
    return project.timeline_positions(df, order=("occurred_at", "n")).select(
        "trace_id", "event_id", "position"
    )


@query(
    "prj_filtered_timeline",
    """WITH {EV} SELECT event_id, run_id, event_type, tool_name FROM evp
    WHERE event_type = 'side_effect.verified' AND status = 'verified' AND trust = 'unknown'
    AND tool_name = 'safe_files.read' AND resource_id = 'file:///data/9.txt'""",
)
def filtered(spark, sf_dir):
    return project.filtered_timeline(
        events(spark, sf_dir),
        event_type="side_effect.verified",
        verification_status="verified",
        trust="unknown",
        tool_name="safe_files.read",
        resource="file:///data/9.txt",
    ).select("event_id", "run_id", "event_type", "tool_name")


@query(
    "prj_extract_key_values",
    """WITH {EV} SELECT event_id, tool_name AS value FROM ev WHERE tool_name IS NOT NULL""",
)
def key_values(spark, sf_dir):
    df = flat_events(spark, sf_dir)
    return project.key_values(df, ["event_id"], "payload", project.TOOL_KEYS)


@query(
    "prj_extract_string_values",
    f"""WITH {{EV}}, v AS (SELECT event_id, unnest([label, tool_name, descriptor_hash, resource_id,
    ack_status, ack_note, outcome, sens_resource, {SEEN}, top_status, link_subject,
    link_relationship, link_evidence, link_corroboration, link_observer, link_status]
    || CASE WHEN has_link THEN {LIMITS} ELSE [] END) AS value FROM ev)
    SELECT value, count(DISTINCT event_id) AS events FROM v WHERE value IS NOT NULL GROUP BY value""",
)
def string_values(spark, sf_dir):
    values = project.string_values(flat_events(spark, sf_dir), ["event_id"], "payload")
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("events"))


@query(
    "prj_extract_summary_values",
    """WITH {EV} SELECT event_id, 'tools' AS field, tool_name AS value FROM ev
    WHERE tool_name IS NOT NULL UNION ALL
    SELECT event_id, 'resources', CASE WHEN k % 2 = 0 THEN '[TRUNCATED original_length=' ||
    length(resource_id) || ' digest=d' || k || ' digest_scope=unknown]' ELSE resource_id END
    FROM ev WHERE resource_id IS NOT NULL""",
)
def summary_values(spark, sf_dir):
    """Resources of even events are bounded captures; their inner name is not searched."""
    df = flat_events(spark, sf_dir, payload=False)
    capture = F.struct(
        F.lit("witspark.capture.v1").alias("marker"),
        F.lit("hidden").alias("name"),
        F.length("resource_id").alias("original_length"),
        F.concat(F.lit("d"), "k").alias("digest"),
    )
    payload = F.when(
        F.col("k") % 2 == 0,
        F.to_json(
            F.struct(
                F.struct(F.col("tool_name").alias("name")).alias("tool_identity"),
                F.struct(F.when(F.col("resource_id").isNotNull(), capture).alias("path")).alias(
                    "target"
                ),
            )
        ),
    ).otherwise(
        F.to_json(
            F.struct(
                F.struct(F.col("tool_name").alias("name")).alias("tool_identity"),
                F.array(F.struct(F.col("resource_id").alias("uri"))).alias("targets"),
            )
        )
    )
    return project.summary_values(
        df.withColumn("payload", payload),
        ["event_id"],
        "payload",
        {"tools": project.TOOL_KEYS, "resources": project.RESOURCE_KEYS},
    )


@query(
    "prj_incident_summary",
    f"""WITH {{EV}}, f AS (
    SELECT run_id, 'principals' AS field, principal_id AS value FROM evp UNION ALL
    SELECT run_id, 'verification_statuses', status FROM evp UNION ALL
    SELECT run_id, 'evidence_links', coalesce(subject, '') || '<-' || coalesce(evidence, '')
      FROM evp WHERE has_link UNION ALL
    SELECT run_id, 'conflicting_event_ids', event_id FROM evp
      WHERE event_type = 'side_effect.conflict_detected' UNION ALL
    SELECT run_id, 'unknown_event_ids', event_id FROM evp WHERE status = 'unknown' UNION ALL
    SELECT run_id, 'detection_hit_event_ids', event_id FROM evp
      WHERE event_type = 'lineage.alert.created' UNION ALL
    SELECT run_id, 'limitations', unnest({LIMITS}) FROM evp WHERE has_link UNION ALL
    SELECT run_id, 'tools', tool_name FROM evp UNION ALL
    SELECT run_id, 'resources', resource_id FROM evp)
    SELECT run_id, field, value, count(*) AS events FROM f WHERE value IS NOT NULL
    GROUP BY run_id, field, value""",
)
def incident_summary(spark, sf_dir):
    return project.incident_summary(events(spark, sf_dir))


@query(
    "prj_status_counts",
    """WITH {EV} SELECT event_type, coalesce(status_b, 'unknown') AS verification_status,
    count(*) AS events FROM evp GROUP BY ALL""",
)
def status_counts(spark, sf_dir):
    return project.status_counts(events(spark, sf_dir, "b"), ["event_type"])


@query(
    "prj_grounded_summary",
    """WITH {EV}, c AS (SELECT run_id, count(*) AS n_events, count_if(status = 'verified') AS ver,
    count_if(status IN ('unknown', 'unverified', 'timed_out', 'conflicting')) AS unc,
    count_if(has_link) AS links, count_if(event_type = 'side_effect.conflict_detected') AS conf
    FROM evp GROUP BY run_id),
    s AS (SELECT run_id, string_agg(status || '=' || cnt, ', ' ORDER BY status) AS shown FROM
    (SELECT run_id, status, count(*) AS cnt FROM evp WHERE status IS NOT NULL GROUP BY ALL) GROUP BY run_id)
    SELECT c.run_id, n_events || ' events for run_id=' || c.run_id || '; ' || ver || ' verified and '
    || unc || ' uncertain outcomes recorded.' AS headline,
    'Verification statuses: ' || coalesce(shown, 'none recorded') AS statuses,
    'Evidence links: ' || links AS link_line,
    'Conflicting events: ' || CASE WHEN conf = 0 THEN 'none recorded' ELSE CAST(conf AS VARCHAR) END
    AS conflict_line, 'Nothing observed does not mean that nothing happened.' AS claim
    FROM c LEFT JOIN s ON c.run_id = s.run_id""",
)
def grounded_summary(spark, sf_dir):
    return project.grounded_summary(events(spark, sf_dir))


@query(
    "prj_graph_nodes",
    """WITH {EV}, r AS (SELECT parent_event_id AS event_id FROM evp UNION SELECT subject FROM evp
    WHERE has_link AND subject IS NOT NULL AND evidence IS NOT NULL UNION
    SELECT evidence FROM evp WHERE has_link AND subject IS NOT NULL AND evidence IS NOT NULL)
    SELECT 'event:' || event_id AS id, 'event' AS kind, event_type AS label FROM evp UNION ALL
    SELECT DISTINCT 'event:' || event_id, 'event_reference', event_id FROM r
      WHERE event_id IS NOT NULL AND event_id NOT IN (SELECT event_id FROM ev) UNION ALL
    SELECT DISTINCT 'principal:' || principal_id, 'principal', principal_id FROM evp UNION ALL
    SELECT DISTINCT 'tool:' || tool_name, 'tool', tool_name FROM evp WHERE tool_name IS NOT NULL UNION ALL
    SELECT DISTINCT 'resource:' || resource_id, 'resource', resource_id FROM evp
      WHERE resource_id IS NOT NULL UNION ALL
    SELECT DISTINCT 'verification_status:' || status, 'verification_status', status FROM evp
      WHERE status IS NOT NULL""",
)
def graph_nodes(spark, sf_dir):
    return graph.graph_nodes(events(spark, sf_dir)).select("id", "kind", "label")


@query(
    "prj_graph_edges",
    """WITH {EV}, e AS (
    SELECT 'event:' || parent_event_id AS src, 'event:' || event_id AS dst, 'causal_parent' AS relationship
      FROM evp WHERE parent_event_id IS NOT NULL UNION ALL
    SELECT 'event:' || event_id, 'principal:' || principal_id, 'performed_by' FROM evp UNION ALL
    SELECT 'event:' || event_id, 'tool:' || tool_name, 'uses_tool' FROM evp WHERE tool_name IS NOT NULL UNION ALL
    SELECT 'event:' || event_id, 'resource:' || resource_id, 'references_resource' FROM evp
      WHERE resource_id IS NOT NULL UNION ALL
    SELECT 'event:' || event_id, 'verification_status:' || status, 'has_verification_status' FROM evp
      WHERE status IS NOT NULL UNION ALL
    SELECT 'event:' || evidence, 'event:' || subject, 'evidence_link:' || link_relationship FROM evp
      WHERE has_link AND subject IS NOT NULL AND evidence IS NOT NULL)
    SELECT DISTINCT 'edge:' || relationship || ':' || src || ':' || dst AS id, src, dst, relationship FROM e""",
)
def graph_edges(spark, sf_dir):
    return graph.graph_edges(events(spark, sf_dir)).select("id", "src", "dst", "relationship")


@query(
    "prj_explain_event",
    """WITH {EV}, r AS (
    SELECT event_id, 'parent' AS relation, parent_event_id AS other FROM evp UNION ALL
    SELECT parent_event_id, 'child', event_id FROM evp UNION ALL
    SELECT subject, 'link_as_subject', event_id FROM evp WHERE has_link UNION ALL
    SELECT evidence, 'link_as_evidence', event_id FROM evp WHERE has_link)
    SELECT * FROM r WHERE event_id IN (SELECT event_id FROM ev) AND other IS NOT NULL""",
)
def explain(spark, sf_dir):
    return project.explain_events(events(spark, sf_dir))


@query(
    "prj_causal_closure",
    """WITH {EV} SELECT event_id, root_event_id AS root, sequence AS depth FROM evc""",
)
def causal_closure(spark, sf_dir):
    return project.causal_depth(flat_events(spark, sf_dir, payload=False))


def _closure_sql(event_type, step):
    return f"""WITH RECURSIVE {{EV}}, s AS (SELECT event_id AS seed FROM evp WHERE event_type = '{event_type}'),
    c AS (SELECT seed, seed AS event_id, 0::BIGINT AS depth FROM s
    UNION ALL SELECT c.seed, {step})
    SELECT seed, event_id, min(depth) AS depth FROM c WHERE depth > 0 GROUP BY ALL"""


def _closure(spark, sf_dir, event_type, direction):
    rows = causal_events(spark, sf_dir)
    seeds = rows.filter(F.col("event_type") == event_type).select("event_id")
    found = project.causal_closure(rows, seeds, direction)
    return found.withColumn("depth", F.col("depth").cast("bigint"))


@query(
    "prj_causal_ancestors",
    _closure_sql(
        "side_effect.unverified",
        "p.event_id AS event_id, c.depth + 1 FROM c JOIN evp e ON e.event_id = c.event_id"
        " JOIN evp p ON p.event_id = e.parent_event_id",
    ),
)
def causal_ancestors(spark, sf_dir):
    """All events that the unverified side effects descend from."""
    return _closure(spark, sf_dir, "side_effect.unverified", "ancestors")


@query(
    "prj_causal_descendants",
    _closure_sql(
        "agent.run.started",
        "e.event_id AS event_id, c.depth + 1 FROM c JOIN evp e ON e.parent_event_id = c.event_id",
    ),
)
def causal_descendants(spark, sf_dir):
    """All events that descend from a started run."""
    return _closure(spark, sf_dir, "agent.run.started", "descendants")


@query(
    "prj_projection_round_trip",
    """WITH {EV} SELECT event_id, strftime(occurred_at, '%Y-%m-%d') AS occurred_on, run_id,
    status AS verification_status FROM evp""",
)
def projection_round_trip(spark, sf_dir):
    """The projection written by day and read again."""
    folder = f"{shared_folder(spark)}/projection-{uuid.uuid4().hex[:12]}"
    project.write_projection(evidence_events(spark, sf_dir), folder)
    return spark.read.parquet(folder).select(
        "event_id", F.date_format("occurred_on", "yyyy-MM-dd").alias("occurred_on"), "run_id", "verification_status"
    )


@query(
    "prj_console_rows",
    f"""WITH {{EV}} SELECT 'timeline' AS part, event_id AS a, event_type AS b,
    coalesce(parent_event_id, 'root') AS c FROM evp UNION ALL
    SELECT 'verification', event_id, coalesce(status_b, 'unknown'),
      coalesce(evidence, '-') || ' ' || coalesce(subject, '-') FROM evp UNION ALL
    SELECT 'links', event_id, link_relationship, coalesce(subject, '-') || ' ' ||
      coalesce(evidence, '-') || ' ' || link_observer FROM evp WHERE has_link UNION ALL
    SELECT 'causal_edges', parent_event_id, event_id, '' FROM evp WHERE parent_event_id IS NOT NULL UNION ALL
    SELECT 'evidence_edges', subject, evidence, link_relationship FROM evp WHERE has_link
      AND subject IN (SELECT event_id FROM ev) AND evidence IN (SELECT event_id FROM ev)""",
)
def console_rows(spark, sf_dir):
    t = project.console_tables(events(spark, sf_dir))

    def part(name, a, b, c):
        return t[name].select(
            F.lit(name).alias("part"), F.expr(a).alias("a"), F.expr(b).alias("b"), F.expr(c).alias("c")
        )

    rows = part("timeline", "event_id", "event_type", "parent")
    for other in (
        part("verification", "event_id", "status", "concat(evidence, ' ', subject)"),
        part(
            "links",
            "event_id",
            "relationship",
            "concat_ws(' ', subject_event_id, evidence_event_id, observer_identity)",
        ),
        part("causal_edges", "source", "target", "''"),
        part("evidence_edges", "source", "target", "relationship"),
    ):
        rows = rows.unionByName(other)
    return rows
