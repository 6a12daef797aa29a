"""Report queries: `events` as runs, `orders` as scorecards, `lineitem` as scores."""

from pyspark.sql import functions as F

from witspark.operators import detect, report as R, redact
from witspark.plans.detection import MIXED, MIXED_SQL, sequence_sql
from witspark.plans.registry import query
from witspark.sources.tables import evidence_events, flat_events, table

_EXPECT = """SELECT DISTINCT trace_id, 'event_type' AS kind, CASE user_id % 3 WHEN 0 THEN 'lineage.alert.created'
 WHEN 1 THEN 'side_effect.timed_out' ELSE 'agent.run.failed' END AS value FROM {t} UNION ALL
 SELECT DISTINCT trace_id, 'status', CASE WHEN user_id % 2 = 0 THEN 'unknown' ELSE 'timed_out' END FROM {t} UNION ALL
 SELECT DISTINCT trace_id, 'forbidden', CASE WHEN user_id % 2 = 0 THEN 'conflicting' ELSE 'observed' END FROM {t}"""


@query(
    "rpt_lifecycle_score",
    f"""WITH {{EV}}, x AS ({_EXPECT.format(t='evp')})
    SELECT trace_id, 'missing_event_type' AS problem, value FROM x WHERE kind = 'event_type' AND NOT EXISTS
      (SELECT 1 FROM evp WHERE evp.trace_id = x.trace_id AND evp.event_type = x.value) UNION ALL
    SELECT trace_id, 'missing_status', value FROM x WHERE kind = 'status' AND NOT EXISTS
      (SELECT 1 FROM evp WHERE evp.trace_id = x.trace_id AND evp.status = x.value) UNION ALL
    SELECT trace_id, 'forbidden_status', value FROM x WHERE kind = 'forbidden' AND EXISTS
      (SELECT 1 FROM evp WHERE evp.trace_id = x.trace_id AND evp.status = x.value)""",
)
def lifecycle_score(spark, sf_dir):
    df = evidence_events(spark, sf_dir)
    df.createOrReplaceTempView("witspark_evidence")
    expect = spark.sql(_EXPECT.format(t="witspark_evidence"))
    return R.lifecycle_score(df, expect, "trace_id")


@query(
    "rpt_detection_score",
    sequence_sql(MIXED_SQL).replace(
        " SELECT rule_id, g AS grp, ids FROM m",
        ", x AS (SELECT DISTINCT trace_id, unnest(['funnel', 'send_unverified', 'skipped']) AS rule_id FROM ev)"
        " SELECT trace_id, rule_id FROM x WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.g = trace_id AND m.rule_id = x.rule_id)",
    ),
)
def detection_score(spark, sf_dir):
    df = flat_events(spark, sf_dir)
    matches = detect.evaluate_rules(df, MIXED[:2]).select(F.col("group_key")[0].alias("trace_id"), "rule_id")
    rules = F.array(*[F.lit(r) for r in ("funnel", "send_unverified", "skipped")])
    expected = df.select("trace_id").distinct().select("trace_id", F.explode(rules).alias("rule_id"))
    return R.detection_score(expected, matches, "trace_id")


@query(
    "rpt_capability_score",
    """SELECT c_custkey AS scenario_id, count(DISTINCT o_orderpriority) AS capabilities, count(o_orderkey) > 0 AS ok
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey""",
)
def capability_score(spark, sf_dir):
    scenarios = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scenario_id"))
    covers = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(
        F.col("o_custkey").alias("scenario_id"), F.col("o_orderpriority").alias("capability")
    )
    return R.capability_score(scenarios, covers)


@query(
    "rpt_replayability_score",
    """WITH w AS (SELECT o_orderkey AS run_id, unnest(['1', '2', '3']) AS artifact FROM orders)
    SELECT run_id, artifact FROM w WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = run_id
    AND CAST(l_linenumber AS VARCHAR) = artifact)""",
)
def replayability(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"))
    artifacts = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("string").alias("artifact")
    )
    return R.replayability(runs, artifacts, ("1", "2", "3"))


_ALL = " AND ".join(f"bool_or(event_type = '{t}')" for t in R.LIFECYCLE)


@query(
    "rpt_run_isolation",
    f"""WITH {{EV}}, ch AS (SELECT DISTINCT trace_id, run_id FROM evp WHERE event_type = 'agent.run.started' AND concurrent_child),
    tg AS (SELECT evp.*, ch.run_id IS NOT NULL AS child FROM evp LEFT JOIN ch ON ch.trace_id = evp.trace_id AND ch.run_id = evp.run_id),
    rq AS (SELECT trace_id, run_id, lag(run_id) OVER (PARTITION BY trace_id ORDER BY occurred_at, n) AS before FROM tg
      WHERE child AND event_type = 'tool.execution.requested'),
    t1 AS (SELECT trace_id, count(*) AS requests, count_if(before <> run_id) AS transitions FROM rq GROUP BY 1),
    st AS (SELECT trace_id, run_id, {_ALL} AS whole FROM tg WHERE child GROUP BY 1, 2),
    t2 AS (SELECT trace_id, count(*) AS child_runs, count_if(NOT whole) AS incomplete_runs FROM st GROUP BY 1),
    t3 AS (SELECT tg.trace_id, count(DISTINCT tg.event_id) AS cross_run_links FROM tg JOIN ev o ON (o.event_id = tg.subject
      OR o.event_id = tg.evidence) AND o.run_id <> tg.run_id WHERE tg.child AND tg.has_link GROUP BY 1),
    t0 AS (SELECT trace_id, count_if(NOT child AND event_type LIKE 'tool.execution.%') AS coordinator_tool_events FROM tg GROUP BY 1),
    a AS (SELECT t0.trace_id, coalesce(child_runs, 0) AS child_runs, coalesce(requests, 0) AS requests,
      coalesce(transitions, 0) AS transitions, coalesce(incomplete_runs, 0) AS incomplete_runs,
      coalesce(cross_run_links, 0) AS cross_run_links, coordinator_tool_events FROM t0 LEFT JOIN t1 ON t1.trace_id = t0.trace_id
      LEFT JOIN t2 ON t2.trace_id = t0.trace_id LEFT JOIN t3 ON t3.trace_id = t0.trace_id)
    SELECT *, child_runs = 2 AND requests >= 4 AND transitions >= 2 AND incomplete_runs = 0 AND cross_run_links = 0
    AND coordinator_tool_events = 0 AS ok FROM a""",
)
def run_isolation(spark, sf_dir):
    return R.run_isolation(evidence_events(spark, sf_dir))


# Scorecards and scores.
_SCORE = """SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
 l_suppkey, l_extendedprice, l_quantity) AS ordinal, 'scorer_' || CAST(l_linenumber AS STRING) AS name,
 l_returnflag <> 'R' AS ok, CASE WHEN l_returnflag = 'R' AND l_suppkey % 3 <> 0 THEN
 CASE l_linestatus WHEN 'O' THEN 'harness_failure' ELSE 'agent_failure' END END AS failure_class FROM {t}"""


def scores(spark, sf_dir):
    from witspark.operators.ordered import in_order

    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    numbered = in_order(table(spark, sf_dir, "lineitem"), ["l_orderkey"], order, {"ordinal": ("row_number", None)})
    bad = F.col("l_returnflag") == "R"
    return numbered.select(
        F.col("l_orderkey").alias("run_id"),
        "ordinal",
        F.concat(F.lit("scorer_"), "l_linenumber").alias("name"),
        (~bad).alias("ok"),
        F.when(
            bad & (F.col("l_suppkey") % 3 != 0),
            F.when(F.col("l_linestatus") == "O", "harness_failure").otherwise("agent_failure"),
        ).alias("failure_class"),
    )


_CARD = """SELECT o_orderkey AS run_id, 'sc_' || o_custkey % 40 AS scenario_id, o_orderstatus <> 'F' AS passed,
 CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'product_failure' ELSE 'agent_failure' END
 WHEN o_orderkey % 10 = 3 THEN 'provider_failure' END AS failure_class,
 CAST(o_orderkey % 3 AS BIGINT) AS replay_count, CAST(o_orderkey % 2 AS BIGINT) AS replay_ok FROM orders"""


def cards(spark, sf_dir):
    key, failed = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").select(
        key.alias("run_id"),
        F.concat(F.lit("sc_"), F.col("o_custkey") % 40).alias("scenario_id"),
        (~failed).alias("passed"),
        F.when(failed, F.when(key % 2 == 0, "product_failure").otherwise("agent_failure"))
        .when(key % 10 == 3, "provider_failure")
        .alias("failure_class"),
        (key % 3).alias("replay_count"),
        (key % 2).alias("replay_ok"),
    )


_S = _SCORE.format(t="lineitem")


@query(
    "rpt_failure_classify",
    f"""WITH s AS ({_S}), f AS (SELECT run_id, arg_min(coalesce(failure_class, 'product_failure'), ordinal) AS c FROM s
    WHERE NOT ok GROUP BY run_id)
    SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 17 = 0 THEN 'inconclusive_budget_exhausted'
    WHEN o_orderkey % 13 = 0 THEN 'provider_failure' WHEN o_orderkey % 11 = 0 THEN 'agent_failure'
    WHEN o_orderkey % 7 = 0 THEN 'harness_failure' ELSE c END AS failure_class
    FROM orders LEFT JOIN f ON f.run_id = o_orderkey""",
)
def failure_classify(spark, sf_dir):
    key = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(
        key.alias("run_id"),
        (key % 17 == 0).alias("budget_exhausted"),
        (key % 13 == 0).alias("provider_error"),
        (key % 11 == 0).alias("agent_error"),
        (key % 7 == 0).alias("harness_error"),
    )
    return R.classify_failures(runs, scores(spark, sf_dir))


@query(
    "rpt_failure_fingerprint",
    f"""WITH s AS ({_S}), c AS ({_CARD}), l AS (SELECT run_id, string_agg('{{"failure_class":' || coalesce('"' || failure_class || '"', 'null')
    || ',"name":"' || name || '","ok":' || ok || '}}', ',' ORDER BY ordinal) AS body FROM s WHERE NOT ok OR failure_class IS NOT NULL GROUP BY run_id)
    SELECT c.run_id, CASE WHEN NOT (passed AND failure_class IS NULL) THEN 'sha256:' || sha256('{{"failure_class":'
    || coalesce('"' || failure_class || '"', 'null') || ',"passed":' || passed || ',"scenario_id":"' || scenario_id
    || '","scores":[' || coalesce(body, '') || ']}}') END AS fingerprint FROM c LEFT JOIN l ON l.run_id = c.run_id""",
)
def failure_fingerprint(spark, sf_dir):
    return R.failure_fingerprint(cards(spark, sf_dir), scores(spark, sf_dir))


@query(
    "rpt_scorecard_summary",
    f"""WITH c AS ({_CARD}) SELECT coalesce(failure_class, 'none') AS failure_class, count(*) AS scorecards,
    count_if(passed) AS passed, count_if(NOT passed) AS failed, sum(replay_count)::BIGINT AS replay_count,
    sum(replay_ok)::BIGINT AS replay_ok FROM c GROUP BY 1""",
)
def scorecard_summary(spark, sf_dir):
    return R.scorecard_summary(cards(spark, sf_dir))


@query("rpt_event_type_coverage", "WITH {EV} SELECT event_type, count(*) AS events FROM ev GROUP BY 1")
def event_type_coverage(spark, sf_dir):
    return R.event_type_coverage(flat_events(spark, sf_dir, payload=False))


@query(
    "rpt_lifecycle_transitions",
    """WITH {EV}, l AS (SELECT event_type, lead(event_type) OVER (PARTITION BY run_id ORDER BY sequence) AS nx FROM evc)
    SELECT event_type || ' -> ' || nx AS transition, count(*) AS times FROM l WHERE nx IS NOT NULL GROUP BY 1""",
)
def transitions(spark, sf_dir):
    return R.transitions(flat_events(spark, sf_dir, payload=False))


@query(
    "rpt_link_coverage",
    """WITH {EV} SELECT 'verification_status' AS dimension, coalesce(nullif(link_status, ''), 'unknown') AS value,
    count(*) AS links FROM evp WHERE has_link GROUP BY 2 UNION ALL
    SELECT 'relationship', link_relationship, count(*) FROM evp WHERE has_link GROUP BY 2 UNION ALL
    SELECT 'corroboration_type', link_corroboration, count(*) FROM evp WHERE has_link GROUP BY 2""",
)
def link_coverage(spark, sf_dir):
    return R.link_coverage(evidence_events(spark, sf_dir))


@query(
    "rpt_tool_identities",
    """WITH {EV} SELECT DISTINCT tool_name AS name, descriptor_hash, '' AS server_identity FROM ev WHERE tool_name IS NOT NULL""",
)
def tool_identities(spark, sf_dir):
    return R.tool_identities(flat_events(spark, sf_dir, payload=False), ["event_id"])


@query(
    "rpt_score_counts",
    f"WITH s AS ({_S}) SELECT name, count_if(ok) AS passed, count_if(NOT ok) AS failed FROM s GROUP BY name",
)
def score_counts(spark, sf_dir):
    return R.score_counts(scores(spark, sf_dir))


@query(
    "rpt_trend_points",
    f"""WITH c AS ({_CARD}) SELECT 'nightly' AS label, count(*) AS scenario_count, count_if(NOT passed) AS failed_count,
    sum(replay_count)::BIGINT AS replay_count, sum(replay_ok)::BIGINT AS replay_ok,
    (SELECT count_if(contains(text, 'password')) FROM documents) AS leak_count,
    count_if(NOT passed) = 0 AND (SELECT count_if(contains(text, 'password')) FROM documents) = 0 AS ok FROM c""",
)
def trend_points(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    audit = redact.leak_audit(docs, ["doc_id"], "text", ("password",)).filter("pattern = 'extra_canary_0'")
    return R.trend_points(cards(spark, sf_dir), audit, "nightly")


@query(
    "rpt_replay_equivalence",
    """SELECT o_orderkey AS run_id, concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'failure_class' END,
    CASE WHEN o_orderkey % 7 = 0 THEN 'passed' END) AS mismatches, o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AS ok FROM orders""",
)
def replay_equivalence(spark, sf_dir):
    first = cards(spark, sf_dir)
    key = F.col("run_id")
    second = first.withColumns(
        {
            "failure_class": F.when(key % 5 == 0, "changed").otherwise(F.col("failure_class")),
            "passed": F.when(key % 7 == 0, ~F.col("passed")).otherwise(F.col("passed")),
        }
    )
    return R.replay_equivalence(first, second, "run_id", ["failure_class", "passed", "scenario_id"])


@query(
    "rpt_report_diff",
    """SELECT o_orderkey, '$.total' AS path, 'value' AS change FROM orders WHERE o_orderkey % 2 = 1 UNION ALL
    SELECT o_orderkey, '$.extra', 'added' FROM orders WHERE o_orderkey % 3 = 0 UNION ALL
    SELECT o_orderkey, '$.gone', 'removed' FROM orders WHERE o_orderkey % 3 = 0 UNION ALL
    SELECT o_orderkey, '$.status', 'type' FROM orders WHERE o_orderkey % 4 = 0 UNION ALL
    SELECT o_orderkey, '$.list.length', 'length' FROM orders WHERE o_orderkey % 5 = 0 UNION ALL
    SELECT o_orderkey, '$.list[0].a', 'value' FROM orders WHERE o_orderkey % 6 = 0""",
)
def report_diff(spark, sf_dir):
    key = F.col("o_orderkey")
    df = table(spark, sf_dir, "orders")
    one = F.struct(F.lit(1).alias("a"))
    left = F.struct(
        key.alias("total"),
        F.when(key % 3 == 0, F.struct(F.lit(1).alias("deep"))).alias("gone"),
        F.col("o_orderstatus").alias("status"),
        F.array(one).alias("list"),
    )
    changed = F.struct(F.when(key % 6 == 0, 2).otherwise(1).alias("a"))
    text = F.to_json(F.struct(F.struct("o_orderstatus").alias("status")))
    right = F.struct(
        (key + key % 2).alias("total"),
        F.when(key % 3 == 0, F.array(F.lit("x"))).alias("extra"),
        F.when(key % 4 != 0, F.col("o_orderstatus")).alias("status"),
        F.when(key % 5 == 0, F.array(changed, one)).otherwise(F.array(changed)).alias("list"),
    )
    left_text = F.to_json(left)
    right_text = F.when(
        key % 4 == 0, F.regexp_replace(F.to_json(right), r"\}$", ',"status":{"in":1}}')
    ).otherwise(F.to_json(right))
    return R.json_diff(
        df.select("o_orderkey", left_text.alias("report")),
        df.select("o_orderkey", right_text.alias("report")),
        ["o_orderkey"],
    )


@query(
    "rpt_input_drift",
    """SELECT url || '#' || page_id AS path, CASE page_id % 4 WHEN 0 THEN 'removed' WHEN 1 THEN 'added' ELSE 'changed' END AS change
    FROM pages WHERE page_id % 4 < 3""",
)
def input_drift(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        F.concat_ws("#", "url", "page_id").alias("path"), F.sha2("html", 256).alias("sha256"), "page_id"
    )
    now = pages.withColumn(
        "sha256", F.when(F.col("page_id") % 4 == 2, F.sha2("sha256", 256)).otherwise(F.col("sha256"))
    )
    return R.input_drift(pages.filter("page_id % 4 <> 1"), now.filter("page_id % 4 <> 0"))


_COVER = """cv AS (SELECT DISTINCT 's' || o_custkey % 300 AS scenario_id, 'cap' || o_orderkey % 37 AS capability FROM orders
 WHERE o_orderpriority = '1-URGENT'), dc AS (SELECT DISTINCT 'cap' || o_orderkey % 37 AS capability,
 's' || o_custkey % 330 AS scenario_id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 4 = 0),
 cp AS (SELECT DISTINCT 'cap' || o_orderkey % 40 AS capability FROM orders WHERE o_orderkey % 40 <> 5),
 sc AS (SELECT DISTINCT 's' || o_custkey % 300 AS scenario_id FROM orders)"""


@query(
    "rpt_coverage_validate",
    f"""WITH {_COVER}, kn AS (SELECT * FROM cv WHERE capability IN (SELECT capability FROM cp)),
    dk AS (SELECT * FROM dc WHERE capability IN (SELECT capability FROM cp))
    SELECT 'missing_capability' AS problem, capability, scenario_id FROM cv WHERE capability NOT IN (SELECT capability FROM cp) UNION ALL
    SELECT 'stale_scenario', capability, scenario_id FROM dk WHERE scenario_id NOT IN (SELECT scenario_id FROM sc) UNION ALL
    SELECT 'uncovered_capability', capability, NULL FROM cp WHERE capability NOT IN (SELECT capability FROM kn) UNION ALL
    SELECT 'declared_not_actual', capability, scenario_id FROM (SELECT capability, scenario_id FROM dk EXCEPT SELECT capability, scenario_id FROM kn) UNION ALL
    SELECT 'actual_not_declared', capability, scenario_id FROM (SELECT capability, scenario_id FROM kn EXCEPT SELECT capability, scenario_id FROM dk)""",
)
def coverage_validate(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")

    def cap(n):
        return F.concat(F.lit("cap"), F.col("o_orderkey") % n).alias("capability")

    def scen(n):
        return F.concat(F.lit("s"), F.col("o_custkey") % n).alias("scenario_id")

    covers = orders.filter("o_orderpriority = '1-URGENT'").select(scen(300), cap(37))
    declared = orders.filter("o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 4 = 0").select(cap(37), scen(330))
    capabilities = orders.filter("o_orderkey % 40 <> 5").select(cap(40))
    return R.coverage_validate(covers, capabilities, declared, orders.select(scen(300)))


@query(
    "rpt_tool_call_listing",
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'body,mode,url' ELSE 'body,path,url' END AS argument_keys,
    CASE WHEN page_id % 2 = 0 THEN 'w' END AS safe_mode, CASE WHEN page_id % 2 = 1 THEN '/p' END AS safe_path,
    CASE WHEN page_id % 3 <> 0 THEN url END AS safe_url FROM pages""",
)
def tool_call_listing(spark, sf_dir):
    even = F.col("page_id") % 2 == 0
    arguments = F.to_json(
        F.struct(
            F.when(even, "w").alias("mode"),
            F.when(~even, "/p").alias("path"),
            F.col("url").alias("url"),
            F.col("html").alias("body"),
        )
    )
    odd = F.to_json(
        F.struct(
            F.when(even, "w").alias("mode"),
            F.when(~even, "/p").alias("path"),
            F.col("page_id").alias("url"),
            F.col("html").alias("body"),
        )
    )
    df = table(spark, sf_dir, "pages").select(
        "page_id", F.when(F.col("page_id") % 3 == 0, odd).otherwise(arguments).alias("arguments")
    )
    return R.tool_calls(df)


@query(
    "rpt_pack_validate",
    """WITH m AS (SELECT page_id % 20 AS pack_id, page_id AS ordinal, CASE WHEN page_id % 9 = 0 THEN 'binary' ELSE 'observer' END AS kind,
    'a' || page_id % 100 AS name, CASE page_id % 8 WHEN 0 THEN '/abs/' || page_id WHEN 1 THEN 'up/../' || page_id ELSE 'p/' || page_id END AS path,
    CASE page_id % 6 WHEN 0 THEN 'md5:x' WHEN 1 THEN 'sha256:' || sha256('other') WHEN 2 THEN NULL ELSE 'sha256:' || sha256(html) END AS sha,
    page_id % 7 = 3 AS lost, html FROM pages),
    f AS (SELECT *, page_id_first FROM m JOIN (SELECT pack_id AS pi, kind AS ki, name AS na, min(ordinal) AS page_id_first FROM m GROUP BY ALL)
      ON pi = pack_id AND ki = kind AND na = name),
    c AS (SELECT *, path LIKE '/%' OR path LIKE '%/../%' AS unsafe FROM f)
    SELECT pack_id, name, path, 'duplicate_artifact' AS code FROM c WHERE ordinal > page_id_first UNION ALL
    SELECT pack_id, name, path, 'unsupported_artifact_kind' FROM c WHERE kind = 'binary' UNION ALL
    SELECT pack_id, name, path, 'unsafe_artifact_path' FROM c WHERE unsafe UNION ALL
    SELECT pack_id, name, path, 'artifact_missing' FROM c WHERE NOT unsafe AND lost UNION ALL
    SELECT pack_id, name, path, 'invalid_sha256_format' FROM c WHERE NOT unsafe AND NOT lost AND sha = 'md5:x' UNION ALL
    SELECT pack_id, name, path, 'sha256_mismatch' FROM c WHERE NOT unsafe AND NOT lost AND sha LIKE 'sha256:%' AND sha <> 'sha256:' || sha256(html) UNION ALL
    SELECT DISTINCT pack_id, NULL, NULL, 'unsupported_schema_version' FROM c WHERE pack_id = 4""",
)
def pack_validate(spark, sf_dir):
    key = F.col("page_id")
    pages = table(spark, sf_dir, "pages")
    digest = F.concat(F.lit("sha256:"), F.sha2("html", 256))
    manifest = pages.select(
        (key % 20).alias("pack_id"),
        F.when(key % 20 == 4, "other/v9").otherwise("witspark/pack-v1").alias("schema_version"),
        key.alias("ordinal"),
        F.when(key % 9 == 0, "binary").otherwise("observer").alias("kind"),
        F.concat(F.lit("a"), key % 100).alias("name"),
        F.when(key % 8 == 0, F.concat(F.lit("/abs/"), key))
        .when(key % 8 == 1, F.concat(F.lit("up/../"), key))
        .otherwise(F.concat(F.lit("p/"), key))
        .alias("path"),
        F.when(key % 6 == 0, "md5:x")
        .when(key % 6 == 1, F.concat(F.lit("sha256:"), F.sha2(F.lit("other"), 256)))
        .when(key % 6 != 2, digest)
        .alias("sha256"),
    )
    files = pages.filter("page_id % 7 <> 3").select(F.concat(F.lit("p/"), key).alias("path"), digest.alias("sha256"))
    return R.pack_validate(manifest, files, "witspark/pack-v1")
