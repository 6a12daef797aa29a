"""Observer queries: `orders` are expectations, `lineitem` rows observer records."""

from pyspark.sql import functions as F

from witspark.operators import observe as O
from witspark.plans.registry import query
from witspark.sources.tables import flat_events, table

_OUTCOME = "CASE k % 5 WHEN 0 THEN 'observed' WHEN 1 THEN 'timed_out' WHEN 2 THEN 'conflicting' WHEN 3 THEN 'unavailable' ELSE 'unverified' END"


def outcomes(spark, sf_dir):
    return flat_events(spark, sf_dir, payload=False).select(
        F.col("event_id").alias("subject"), F.expr(_OUTCOME).alias("outcome")
    )


@query(
    "obs_verify_outcome",
    f"""WITH {{EV}}, o AS (SELECT event_id AS subject, {_OUTCOME} AS outcome FROM ev)
    SELECT subject, outcome, CASE outcome WHEN 'observed' THEN 'verified' WHEN 'timed_out' THEN 'timed_out'
    WHEN 'conflicting' THEN 'conflicting' ELSE 'unverified' END AS verification_status,
    CASE outcome WHEN 'observed' THEN 'corroborates' WHEN 'conflicting' THEN 'contradicts' ELSE 'limits' END AS relationship,
    CASE outcome WHEN 'observed' THEN 'side_effect.verified' WHEN 'timed_out' THEN 'side_effect.timed_out'
    WHEN 'conflicting' THEN 'side_effect.conflict_detected' ELSE 'side_effect.unverified' END AS event_type FROM o""",
)
def verify_outcome(spark, sf_dir):
    return O.verify(outcomes(spark, sf_dir))


@query(
    "obs_observation_outcome",
    f"""WITH {{EV}}, o AS (SELECT event_id AS subject, {_OUTCOME} AS outcome FROM ev)
    SELECT subject, outcome, CASE WHEN outcome IN ('observed', 'timed_out', 'conflicting') THEN outcome
    ELSE 'unverified' END AS verification_status,
    CASE outcome WHEN 'observed' THEN 'side_effect.observed' WHEN 'timed_out' THEN 'side_effect.timed_out'
    WHEN 'conflicting' THEN 'side_effect.conflict_detected' ELSE 'side_effect.unverified' END AS event_type FROM o""",
)
def observation_outcome(spark, sf_dir):
    return O.observation_rows(outcomes(spark, sf_dir))


@query(
    "obs_self_reported",
    """WITH {EV} SELECT event_id AS subject_event_id, event_id AS evidence_event_id, 'limits' AS relationship,
    CAST(0.2 AS DOUBLE) AS confidence, 'unverified' AS verification_status FROM ev
    WHERE event_type = 'tool.execution.acknowledged'""",
)
def self_reported(spark, sf_dir):
    df = flat_events(spark, sf_dir, payload=False).filter("event_type = 'tool.execution.acknowledged'")
    return O.self_reported(df).select(
        "subject_event_id", "evidence_event_id", "relationship", "confidence", "verification_status"
    )


# Expectations and records share a key made from customers and parts.
_EXPECT = """SELECT o_orderkey AS id, 'u' || CAST(o_custkey % 1500 AS STRING) AS url,
 CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus || CAST(o_orderkey % 12 AS STRING) END AS body_digest,
 CASE WHEN o_orderkey % 3 <> 0 THEN 1 + o_orderkey % 7 END AS status_code,
 CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'get' ELSE 'Post' END END AS method,
 CASE WHEN o_orderkey % 6 = 1 THEN 'e' || CAST(o_orderkey % 3 AS STRING) END AS etag FROM orders"""
_RECORD = """SELECT 'u' || CAST(l_partkey * 3 % 4000 AS STRING) AS url,
 CASE l_returnflag WHEN 'A' THEN 'F' WHEN 'N' THEN 'O' ELSE 'P' END || CAST(l_suppkey % 12 AS STRING) AS body_digest,
 CAST(l_linenumber AS BIGINT) AS status_code, CASE WHEN l_linestatus = 'O' THEN 'GET' ELSE 'post' END AS method,
 CASE WHEN l_suppkey % 2 = 0 THEN 'e' || CAST(l_suppkey % 3 AS STRING) END AS etag,
 l_orderkey AS a, l_linenumber AS b, l_partkey AS c, l_suppkey AS d, l_extendedprice AS e FROM lineitem"""


def pair(spark, sf_dir, key="url"):
    for name in ("orders", "lineitem"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"witspark_{name}")
    expect = spark.sql(_EXPECT.replace("FROM orders", "FROM witspark_orders"))
    record = spark.sql(_RECORD.replace("FROM lineitem", "FROM witspark_lineitem"))
    record = record.withColumn("ordinal", F.struct("a", "b", "c", "d", "e")).drop("a", "b", "c", "d", "e")
    return expect.withColumnRenamed("url", key), record.withColumnRenamed("url", key)


def _match_sql(narrow, checks):
    """Count exact and candidate records per expectation; SQL may form the pairs."""

    def same(c):
        sides = (f"upper(x.{c})", f"upper(r.{c})") if c == "method" else (f"x.{c}", f"r.{c}")
        return f"(x.{c} IS NULL OR coalesce({sides[0]} = {sides[1]}, false))"

    wide = " AND ".join(["true"] + [same(c) for c in narrow])
    exact = " AND ".join(["true"] + [same(c) for c in checks])
    wrong = ", ".join(
        f"CASE WHEN {c} IS NOT NULL AND first.{c} IS DISTINCT FROM {c} THEN '{c}' END" for c in checks
    )
    packed = "{" + ", ".join(f"'{c}': r.{c}" for c in checks) + "}"
    return f"""WITH x AS ({_EXPECT}), r AS ({_RECORD}),
    p AS (SELECT x.*, r.url IS NOT NULL AND {wide} AS wide, r.url IS NOT NULL AND {wide} AND {exact} AS exact,
      {packed} AS rec, (r.a, r.b, r.c, r.d, r.e) AS ord FROM x LEFT JOIN r ON r.url = x.url),
    g AS (SELECT id, any_value(body_digest) AS body_digest, any_value(status_code) AS status_code,
      any_value(etag) AS etag, count_if(exact) AS exact_count, count_if(wide) AS candidate_count,
      arg_min(rec, ord) FILTER (WHERE wide) AS first FROM p GROUP BY id),
    o AS (SELECT *, CASE WHEN exact_count = 1 THEN 'observed' WHEN exact_count > 1 THEN 'unverified'
      WHEN candidate_count > 0 THEN 'conflicting' ELSE 'unverified' END AS outcome FROM g)
    SELECT id, outcome, exact_count, candidate_count,
    CASE WHEN outcome = 'conflicting' THEN concat_ws(',', {wrong}) END AS conflicts FROM o"""


def _shown(df):
    return df.select("id", "outcome", "exact_count", "candidate_count", "conflicts")


@query("obs_match_receipts", _match_sql([], ["body_digest"]))
def match_receipts(spark, sf_dir):
    return _shown(O.match_receipts(*pair(spark, sf_dir, "destination")))


@query("obs_match_access_log", _match_sql(["method"], ["body_digest", "status_code"]))
def match_access_log(spark, sf_dir):
    return _shown(O.match_access_log(*pair(spark, sf_dir)))


@query("obs_match_responses", _match_sql([], ["body_digest", "etag", "status_code"]))
def match_responses(spark, sf_dir):
    return _shown(O.match_responses(*pair(spark, sf_dir)))


@query("obs_match_webhooks", _match_sql(["etag"], ["body_digest", "status_code"]))
def match_webhooks(spark, sf_dir):
    """The tag of the records plays the delivery id."""
    expect, record = pair(spark, sf_dir, "callback_url")
    return _shown(
        O.match_webhooks(
            expect.withColumnRenamed("etag", "delivery_id"), record.withColumnRenamed("etag", "delivery_id")
        )
    )


@query(
    "obs_process_outcome",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'timed_out' ELSE 'observed' END AS outcome FROM orders""",
)
def process_outcome(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("timed_out", F.col("o_orderstatus") == "P")
    return O.process_rows(df).select("o_orderkey", "outcome")


@query(
    "obs_row_readback",
    """WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 100 END AS l_suppkey,
    CASE WHEN o_orderkey % 3 <> 1 AND o_orderkey % 7 <> 0 THEN 1 + o_orderkey % 8 END AS l_linenumber,
    o_orderkey % 2 = 0 AS expected_exists FROM orders),
    s AS (SELECT l_suppkey, count(*) AS c FROM lineitem GROUP BY 1), n AS (SELECT l_linenumber, count(*) AS c FROM lineitem GROUP BY 1),
    b AS (SELECT l_suppkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY 1, 2),
    m AS (SELECT x.id, x.expected_exists, x.l_suppkey IS NOT NULL OR x.l_linenumber IS NOT NULL AS given,
    coalesce(CASE WHEN x.l_suppkey IS NULL THEN n.c WHEN x.l_linenumber IS NULL THEN s.c ELSE b.c END, 0) AS c
    FROM x LEFT JOIN s ON s.l_suppkey = x.l_suppkey LEFT JOIN n ON n.l_linenumber = x.l_linenumber
    LEFT JOIN b ON b.l_suppkey = x.l_suppkey AND b.l_linenumber = x.l_linenumber)
    SELECT id, CASE WHEN given THEN c END AS matching_rows, CASE WHEN NOT given THEN 'unavailable'
    WHEN (c > 0) = expected_exists THEN 'observed' ELSE 'conflicting' END AS outcome FROM m""",
)
def row_readback(spark, sf_dir):
    key = F.col("o_orderkey")
    expect = table(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.when(key % 3 != 0, F.col("o_custkey") % 100).alias("l_suppkey"),
        F.when((key % 3 != 1) & (key % 7 != 0), 1 + key % 8).alias("l_linenumber"),
        (key % 2 == 0).alias("expected_exists"),
    )
    rows = O.row_readback(expect, table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_linenumber"])
    return rows.select("id", "matching_rows", "outcome")


@query(
    "obs_file_state",
    """WITH x AS (SELECT o_orderkey, 'f' || o_orderkey % 900 AS path, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS want FROM orders),
    f AS (SELECT 'f' || page_id AS path, octet_length(encode(html)) AS size_bytes FROM pages)
    SELECT o_orderkey, size_bytes, CASE WHEN want <> (size_bytes IS NOT NULL) THEN 'conflicting'
    WHEN size_bytes IS NOT NULL THEN 'observed' ELSE 'unverified' END AS outcome FROM x LEFT JOIN f ON f.path = x.path""",
)
def file_state(spark, sf_dir):
    key = F.col("o_orderkey")
    expect = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("f"), key % 900).alias("path"),
        F.when(key % 3 == 0, True).when(key % 3 == 1, False).alias("expected_exists"),
    )
    inventory = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("f"), "page_id").alias("path"), F.octet_length("html").cast("bigint").alias("size_bytes")
    )
    return O.file_state(expect, inventory).select("o_orderkey", "size_bytes", "outcome")


_CLOUD = "l_orderkey AS a, l_linenumber AS b, l_partkey AS c, l_suppkey AS d, l_extendedprice AS e"


def cloud_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        *[part.strip() for part in _CLOUD.split(",")], "l_returnflag AS f", "l_linestatus AS s"
    )


def _verdict(seen, lost="f = 'R' AND s = 'F'"):
    return f"CASE WHEN {lost} THEN 'unverified' WHEN {seen} THEN 'observed' ELSE 'conflicting' END AS outcome"


def _given(record):
    return F.when(~((F.col("f") == "R") & (F.col("s") == "F")), record).alias("record")


_CLOUD_SQL = f"WITH t AS (SELECT {_CLOUD}, l_returnflag AS f, l_linestatus AS s FROM lineitem) SELECT a, b, c, d, e, "


def _cloud_shown(df):
    return df.select("a", "b", "c", "d", "e", "outcome")


@query("obs_aws_s3_write", _CLOUD_SQL + _verdict("b IN (1, 2, 3) AND d % 4 <> 0 AND c % 2 = 0") + " FROM t")
def aws(spark, sf_dir):
    name = F.element_at(
        F.array(*[F.lit(n) for n in ("PutObject", "CopyObject", "CompleteMultipartUpload", "GetObject")]),
        F.least("b", F.lit(4)),
    )
    record = F.struct(
        F.lit("s3.amazonaws.com").alias("eventSource"),
        name.alias("eventName"),
        F.struct(
            F.when(F.col("d") % 4 != 0, "logs").otherwise("other").alias("bucketName"),
            F.when(F.col("c") % 2 == 0, F.col("c")).otherwise(F.lit(-1)).cast("string").alias("key"),
        ).alias("requestParameters"),
    )
    df = cloud_rows(spark, sf_dir).select(
        "*", F.lit("logs").alias("bucket"), F.col("c").cast("string").alias("key"), _given(record)
    )
    return _cloud_shown(O.aws_s3_write(df))


@query("obs_gcp_object_write", _CLOUD_SQL + _verdict("b < 3 AND d % 3 <> 0") + " FROM t")
def gcp(spark, sf_dir):
    record = F.struct(
        F.struct(
            F.lit("storage.googleapis.com").alias("serviceName"),
            F.when(F.col("b") == 1, "storage.objects.create")
            .when(F.col("b") == 2, "storage.objects.update")
            .otherwise("storage.objects.get")
            .alias("methodName"),
            F.lit("").alias("resourceName"),
        ).alias("protoPayload"),
        F.concat(
            F.lit("projects/_/buckets/logs/objects/"), F.when(F.col("d") % 3 != 0, F.col("c")).otherwise(F.lit(-1))
        ).alias("resourceName"),
    )
    df = cloud_rows(spark, sf_dir).select(
        "*", F.lit("logs").alias("bucket"), F.col("c").cast("string").alias("object_name"), _given(record)
    )
    return _cloud_shown(O.gcp_object_write(df))


@query("obs_azure_blob_write", _CLOUD_SQL + _verdict("b <> 4 AND d % 5 <> 0") + " FROM t")
def azure(spark, sf_dir):
    record = F.struct(
        F.when(F.col("b") == 4, "blobs/read").otherwise("blobs/write").alias("operationName"),
        F.concat(
            F.lit("/ACCOUNTS/Acct/containers/LOGS/blobs/"),
            F.when(F.col("d") % 5 != 0, F.concat(F.lit("BLOB"), "c")).otherwise("none"),
        ).alias("resourceId"),
    )
    df = cloud_rows(spark, sf_dir).select(
        "*",
        F.lit("acct").alias("account"),
        F.lit("Logs").alias("container"),
        F.concat(F.lit("blob"), "c").alias("blob"),
        _given(record),
    )
    return _cloud_shown(O.azure_blob_write(df))


@query(
    "obs_k8s_change",
    _CLOUD_SQL + _verdict("b <> 7 AND d % 6 <> 0 AND (c % 2 = 0 OR b % 2 = 1) AND c % 5 <> 0") + " FROM t",
)
def k8s(spark, sf_dir):
    record = F.struct(
        F.when(F.col("b") == 7, "RequestReceived").otherwise("ResponseComplete").alias("stage"),
        F.when(F.col("b") % 2 == 1, "create").otherwise("delete").alias("verb"),
        F.struct(
            F.lit("pods").alias("resource"),
            F.concat(F.lit("pod"), "c").alias("name"),
            F.when(F.col("c") % 5 == 0, "").otherwise("default").alias("namespace"),
            F.lit(None).cast("string").alias("apiGroup"),
        ).alias("objectRef"),
        F.struct(F.when(F.col("d") % 6 == 0, 403).otherwise(201).alias("code")).alias("responseStatus"),
    )
    df = cloud_rows(spark, sf_dir).select(
        "*",
        F.lit("pods").alias("resource"),
        F.concat(F.lit("pod"), "c").alias("name"),
        F.lit("default").alias("namespace"),
        F.when(F.col("c") % 2 == 1, "create").alias("verb"),
        F.lit("").alias("api_group"),
        _given(record),
    )
    return _cloud_shown(O.k8s_change(df))


@query(
    "obs_sensor_normalize",
    f"""SELECT o_orderkey, '{O.R_HIDDEN}' AS hidden, CAST(o_custkey AS VARCHAR) AS shown,
    'clock drift,' || CASE WHEN o_orderkey % 2 = 0 THEN 'sampled,' ELSE '' END || '{O.SENSOR_NOTE}' AS limitations,
    n_name AS producer FROM orders JOIN nation ON n_nationkey = o_custkey % 20""",
)
def sensor(spark, sf_dir):
    """Nations declare the sensors; orders are their records."""
    declared = table(spark, sf_dir, "nation").filter("n_nationkey < 20").select(
        F.concat(F.lit("sensor_"), "n_nationkey").alias("sensor_id"),
        F.array(F.lit("clock drift")).alias("limitations"),
        F.lit("external").alias("trust"),
        F.col("n_name").alias("producer"),
    )
    records = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("sensor_"), F.col("o_custkey") % 20).alias("sensor_id"),
        F.to_json(F.struct(F.lit("x").alias("password"), F.col("o_custkey").alias("count"))).alias("observed_state"),
        F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("sampled"))).alias("limitations"),
    )
    return O.sensor_rows(records, declared).select(
        "o_orderkey",
        F.get_json_object("observed_state", "$.password.value").alias("hidden"),
        F.get_json_object("observed_state", "$.count").alias("shown"),
        F.array_join("limitations", ",").alias("limitations"),
        "producer",
    )


_REASONS = [
    ("s_suppkey % 4 = 0", "observer_differs"),
    ("s_suppkey % 5 = 0", "not_live_telemetry"),
    ("o_orderstatus = 'P'", "no_action_type"),
    ("o_orderstatus = 'O' AND s_suppkey % 3 <> 0", "action_not_covered"),
    ("o_orderkey % 6 = 0", "no_resource_type"),
    ("o_orderkey % 6 = 1", "resource_not_covered"),
    ("rev > DATE '2024-06-30'", "reviewed_later"),
    ("s_suppkey % 7 = 0", "attestation_expired"),
    ("date_diff('day', rev, DATE '2024-06-30') > 365", "review_too_old"),
    ("s_suppkey % 9 = 0", "dependencies_shared"),
] + [
    item
    for b in O.BOUNDARIES
    for item in (
        (
            ("s_suppkey % 10 = 3", f"boundary_missing:{b}")
            if b == O.BOUNDARIES[1]
            else ("s_suppkey % 10 = 4", f"boundary_shared:{b}")
            if b == O.BOUNDARIES[2]
            else ("false", "")
        ),
    )
]


@query(
    "obs_independence_reasons",
    "WITH j AS (SELECT *, DATE '2023-01-01' + CAST(s_suppkey * 8 % 800 AS INTEGER) AS rev FROM orders LEFT JOIN supplier"
    " ON s_suppkey = o_orderkey % 110) SELECT o_orderkey, CASE WHEN s_suppkey IS NULL THEN"
    " 'no_attestation' ELSE concat_ws(';', "
    + ", ".join(f"CASE WHEN {test} THEN '{text}' END" for test, text in _REASONS)
    + ") END AS reasons FROM j",
)
def independence(spark, sf_dir):
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    claims = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (key % 110).alias("attestation_id"),
        F.lit("watcher").alias("observer"),
        F.when(status == "P", " ").when(status == "O", "write").otherwise("read").alias("action_type"),
        F.when(key % 6 == 1, "process").when(key % 6 != 0, "file").alias("resource_type"),
    )
    sup = F.col("s_suppkey")
    kinds = {b: F.lit("independent") for b in O.BOUNDARIES}
    kinds[O.BOUNDARIES[2]] = F.when(sup % 10 == 4, "shared").otherwise("independent")
    full = F.map_from_arrays(F.array(*[F.lit(b) for b in kinds]), F.array(*kinds.values()))
    attestations = table(spark, sf_dir, "supplier").select(
        sup.alias("attestation_id"),
        F.when(sup % 4 == 0, "other").otherwise("watcher").alias("observer_identity"),
        F.when(sup % 5 == 0, "fixture").otherwise("independent_live_telemetry").alias("evidence_kind"),
        F.when(sup % 3 == 0, F.array(F.lit("*"))).otherwise(F.array(F.lit("read"))).alias("action_types"),
        F.array(F.lit("file")).alias("resource_types"),
        F.date_add(F.lit("2023-01-01").cast("date"), (sup * 8 % 800).cast("int")).alias("reviewed_at"),
        F.when(sup % 7 == 0, F.lit("2024-01-01").cast("date")).alias("valid_until"),
        F.when(sup % 9 == 0, F.array(F.lit("dns"))).otherwise(F.array().cast("array<string>")).alias(
            "shared_dependencies"
        ),
        F.when(sup % 10 == 3, F.map_filter(full, lambda k, _v: k != O.BOUNDARIES[1])).otherwise(full).alias(
            "boundaries"
        ),
    )
    rows = O.independence_reasons(claims, attestations, F.lit("2024-06-30").cast("date"))
    return rows.select("o_orderkey", F.array_join("reasons", ";").alias("reasons"))
