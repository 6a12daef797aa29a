"""Ingest queries over `events`, `part`, `customer` and `nation`."""

from pyspark.sql import functions as F

from witspark.operators import ingest as G
from witspark.plans.registry import query
from witspark.sources.tables import evidence_events, flat_events, table

LIMITS = "CASE WHEN limit_text = '' THEN [] ELSE string_split(limit_text, '|') END"


def _at(name, path):
    return F.get_json_object("payload", path).alias(name)


@query(
    "ing_record_from_action",
    """WITH {EV} SELECT 'act:' || event_id AS idempotency_key, 'action.normalized' AS event_type,
    source_type AS action_type, resource_id AS identifier, tool_name AS tool,
    CASE WHEN tool_name IS NULL THEN 0 ELSE 1 END::BIGINT AS has_tool FROM ev""",
)
def record_from_action(spark, sf_dir):
    df = flat_events(spark, sf_dir, payload=False).select(
        F.concat(F.lit("act:"), "event_id").alias("idempotency_key"),
        F.col("source_type").alias("action_type"),
        F.filter(
            F.array(F.when(F.col("resource_id").isNotNull(), F.struct(F.col("resource_id").alias("identifier"), F.lit("file").alias("resource_type")))),
            lambda r: r.isNotNull(),
        ).alias("resources"),
        F.when(F.col("tool_name").isNotNull(), F.struct(F.col("tool_name").alias("name"), "descriptor_hash")).alias(
            "tool_identity"
        ),
        F.lit(None).cast("struct<initiating_principal_id:string>").alias("delegated_identity"),
        F.struct("k").alias("attributes"),
    )
    return G.records_from_actions(df).select(
        "idempotency_key",
        "event_type",
        _at("action_type", "$.action.action_type"),
        _at("identifier", "$.action.resources[0].identifier"),
        _at("tool", "$.action.tool_identity.name"),
        F.contains("payload", F.lit('"tool_identity"')).cast("bigint").alias("has_tool"),
    )


@query(
    "ing_record_from_observation",
    f"""WITH {{EV}} SELECT event_id AS idempotency_key, 'side_effect.observed' AS event_type,
    'observer_' || k % 3 AS observer, resource_id AS identifier, status AS verification_status,
    CASE WHEN has_link THEN len({LIMITS}) ELSE 0 END AS limits FROM evp
    WHERE event_type LIKE 'side_effect.%'""",
)
def record_from_observation(spark, sf_dir):
    df = evidence_events(spark, sf_dir).filter("event_type LIKE 'side_effect.%'")
    df = df.select(
        F.col("event_id").alias("idempotency_key"),
        F.concat(F.lit("observer_"), F.col("k") % 3).alias("observer_identity"),
        F.struct(F.col("resource_id").alias("identifier")).alias("resource"),
        F.struct("k").alias("observed_state"),
        "verification_status",
        F.coalesce("evidence_link.limitations", F.array().cast("array<string>")).alias("limitations"),
    )
    return G.records_from_observations(df).select(
        "idempotency_key",
        "event_type",
        _at("observer", "$.observer_identity"),
        _at("identifier", "$.resource.identifier"),
        _at("verification_status", "$.verification_status"),
        F.json_array_length(F.get_json_object("payload", "$.limitations")).cast("bigint").alias("limits"),
    )


@query(
    "ing_record_from_verification",
    """WITH {EV} SELECT 'ver:' || event_id AS idempotency_key, 'side_effect.verified' AS event_type,
    subject AS subject, link_relationship AS relationship, nullif(link_status, '') AS link_status
    FROM evp WHERE has_link""",
)
def record_from_verification(spark, sf_dir):
    df = evidence_events(spark, sf_dir).filter("evidence_link IS NOT NULL")
    df = df.select(F.concat(F.lit("ver:"), "event_id").alias("idempotency_key"), "evidence_link")
    return G.records_from_verifications(df).select(
        "idempotency_key",
        "event_type",
        _at("subject", "$.evidence_link.subject_event_id"),
        _at("relationship", "$.evidence_link.relationship"),
        _at("link_status", "$.evidence_link.verification_status"),
    )


@query(
    "ing_evidence_link_validate",
    f"""WITH {{EV}} SELECT event_id, concat_ws(',', CASE WHEN subject IS NULL THEN 'subject_event_id' END,
    CASE WHEN evidence IS NULL THEN 'evidence_event_id' END,
    CASE WHEN link_relationship = 'endorses' THEN 'relationship' END,
    CASE WHEN link_status IS NULL THEN 'verification_status' END,
    CASE WHEN link_confidence > 1 THEN 'confidence' END,
    CASE WHEN limit_text = '|late' THEN 'limitations' END) AS errors FROM evp WHERE has_link""",
)
def link_validate(spark, sf_dir):
    return G.validate_links(evidence_events(spark, sf_dir)).select(
        "event_id", F.array_join("errors", ",").alias("errors")
    )


def records(spark, sf_dir):
    """Records of all events; some carry earlier ingest and provenance members."""
    payload = F.to_json(
        F.struct(
            "k",
            "label",
            F.when(F.col("k") % 4 == 0, F.struct(F.lit("old").alias("idempotency_key"))).alias("ingest"),
            F.when(
                F.col("k") % 6 == 0,
                F.struct(
                    F.when(F.col("k") % 12 == 0, G.PROVENANCE_VERSION).otherwise("theirs").alias("schema_version")
                ),
            ).alias("ingested_by"),
        )
    )
    return flat_events(spark, sf_dir, payload=False).select(
        F.concat(F.lit("key_"), F.col("n") % 4000).alias("idempotency_key"),
        F.concat(F.lit("s"), F.col("user_id") % 7).alias("sort_key"),
        "event_type",
        F.lit("fixture").alias("source_kind"),
        payload.alias("payload"),
        "event_id",
        F.col("n").alias("arrival"),
        "k",
        "trace_id",
        "user_id",
    )


_CONTEXT = {
    "classification": '{"trust":"local"}',
    "principal": '{"principal_id":"p"}',
    "source": '{"component":"c"}',
}


def fingerprinted(spark, sf_dir):
    context = {name: F.lit(text) for name, text in _CONTEXT.items()}
    context["correlation"] = F.to_json(F.struct("trace_id"))
    return G.record_fingerprint(records(spark, sf_dir), context)


_PRINT = f"""r AS (SELECT ev.*, 'key_' || n % 4000 AS key, 's' || user_id % 7 AS sort_key, 'sha256:' || sha256(
 '{{"classification":{_CONTEXT['classification']},"correlation":{{"trace_id":"' || trace_id
 || '"}},"event_type":"' || event_type || '","idempotency_key":"key_' || n % 4000 || '","payload":{{'
 || CASE WHEN k % 6 = 0 AND k % 12 <> 0 THEN '"ingested_by":{{"schema_version":"theirs"}},' ELSE '' END
 || '"k":' || k || ',"label":"' || label || '"}},"principal":{_CONTEXT['principal']},"sort_key":"s' || user_id % 7
 || '","source":{_CONTEXT['source']},"source_kind":"fixture","version":"{G.FINGERPRINT_VERSION}"}}') AS fp FROM ev)"""


@query("ing_record_fingerprint", f"WITH {{EV}}, {_PRINT} SELECT event_id, fp AS fingerprint FROM r")
def record_fingerprint(spark, sf_dir):
    return fingerprinted(spark, sf_dir).select("event_id", "fingerprint")


def outcomes(spark, sf_dir):
    """Import of all records: content is the label, keys repeat, label 3 is invalid."""
    df = records(spark, sf_dir).select(
        "idempotency_key",
        "sort_key",
        "arrival",
        "event_id",
        "user_id",
        F.sha2(F.concat_ws(":", "idempotency_key", F.col("k") % 2), 256).alias("fingerprint"),
        (F.col("k") % 10 != 3).alias("valid"),
    )
    existing = df.filter("user_id % 5 = 0").select(
        "idempotency_key",
        F.concat(F.lit("old_"), "event_id").alias("event_id"),
        F.when(F.col("arrival") % 3 != 0, F.col("fingerprint")).alias("fingerprint"),
        F.col("arrival").alias("position"),
    )
    return G.import_batch(df, existing)


_IMPORT = """r AS (SELECT 'key_' || n % 4000 AS key, 's' || user_id % 7 AS sort_key, n, event_id, user_id,
 sha256('key_' || n % 4000 || ':' || k % 2) AS fp, k % 10 <> 3 AS valid FROM ev),
 o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sort_key, n) AS pos FROM r),
 c AS (SELECT key, min(pos) AS pos FROM o WHERE valid GROUP BY key),
 cl AS (SELECT o.key, o.pos, o.event_id, o.fp FROM o JOIN c ON c.key = o.key AND c.pos = o.pos),
 st AS (SELECT key, arg_max({'e': 'old_' || event_id, 'f': CASE WHEN n % 3 <> 0 THEN fp END}, n) AS s
  FROM r WHERE user_id % 5 = 0 GROUP BY key),
 e AS (SELECT o.*, st.s IS NOT NULL OR (cl.pos IS NOT NULL AND cl.pos < o.pos) AS taken,
  CASE WHEN st.s IS NOT NULL THEN st.s.e ELSE cl.event_id END AS prior,
  CASE WHEN st.s IS NOT NULL THEN st.s.f ELSE cl.fp END AS prior_fp
  FROM o LEFT JOIN cl ON cl.key = o.key LEFT JOIN st ON st.key = o.key),
 out AS (SELECT key, n, user_id, CASE WHEN taken THEN CASE WHEN prior_fp IS NULL OR prior_fp = fp THEN 'duplicate'
  ELSE 'conflict' END WHEN valid THEN 'imported' ELSE 'failed' END AS status,
  CASE WHEN taken THEN prior WHEN valid THEN event_id END AS event_id FROM e)"""


@query(
    "ing_idempotent_import",
    f"WITH {{EV}}, {_IMPORT} SELECT key AS idempotency_key, n AS arrival, status, event_id FROM out",
)
def idempotent_import(spark, sf_dir):
    return outcomes(spark, sf_dir).select("idempotency_key", "arrival", "status", "event_id")


@query(
    "ing_import_summary",
    f"""WITH {{EV}}, {_IMPORT}, s AS (SELECT n % 50 AS batch, count_if(status = 'imported') AS imported,
    count_if(status = 'duplicate') AS duplicate, count_if(status = 'conflict') AS conflict,
    count_if(status = 'failed') AS failed FROM out GROUP BY 1)
    SELECT *, failed = 0 AND conflict = 0 AS ok FROM s""",
)
def import_summary(spark, sf_dir):
    rows = outcomes(spark, sf_dir).withColumn("batch", F.col("arrival") % 50)
    return G.import_summary(rows, ["batch"])


@query(
    "ing_assign_causality",
    """WITH {EV} SELECT event_id, row_number() OVER w + 99 AS sequence, lag(event_id) OVER w AS parent_event_id,
    first_value(event_id) OVER w AS root_event_id FROM ev WINDOW w AS (PARTITION BY trace_id ORDER BY occurred_at, n)""",
)
def assign_causality(spark, sf_dir):
    df = flat_events(spark, sf_dir, payload=False).drop("sequence", "parent_event_id", "root_event_id")
    rows = G.assign_causality(df, ["trace_id"], ["occurred_at", "n"], initial=100)
    return rows.select("event_id", "sequence", "parent_event_id", "root_event_id")


@query(
    "ing_ingest_metadata_stamp",
    f"""WITH {{EV}}, {_PRINT} SELECT event_id, fp AS record_fingerprint, k % 6 = 0 AS rejected,
    CASE WHEN k % 6 <> 0 THEN 'principal:svc_' || user_id % 4 END AS credential,
    CASE WHEN k % 6 <> 0 THEN 'read,write' END AS roles FROM r""",
)
def stamp(spark, sf_dir):
    df = fingerprinted(spark, sf_dir).withColumn("payload_v", F.try_parse_json("payload"))
    rows = G.stamp_ingest(
        df,
        F.concat(F.lit("svc_"), F.col("user_id") % 4),
        F.array(F.lit("write"), F.lit("read")),
        F.concat(F.lit("req_"), "event_id"),
    )
    return rows.select(
        "event_id",
        "ingest.record_fingerprint",
        "rejected",
        F.col("ingested_by.credential_identifier").alias("credential"),
        F.array_join("ingested_by.authenticated_roles", ",").alias("roles"),
    )


@query(
    "ing_trusted_claim_guard",
    """WITH {EV} SELECT event_id, principal_id FROM ev WHERE trust = 'trusted'
    AND NOT (user_id % 10 IN (2, 5) )""",
)
def trusted_guard(spark, sf_dir):
    """Principals 2 and 5 hold the admin role, the others read, write or nothing at all."""
    df = flat_events(spark, sf_dir, payload=False)
    number = F.regexp_extract("principal_id", "([0-9]+)", 1).cast("int")
    principals = df.select("principal_id").distinct().filter(number != 9).select(
        "principal_id",
        F.when(number.isin(2, 5), F.array(F.lit("read"), F.lit("admin")))
        .otherwise(F.array(F.lit("read"), F.lit("write")))
        .alias("roles"),
    )
    return G.guard_trusted(df, principals)


@query(
    "ing_provenance_listing",
    """WITH {EV} SELECT event_id, CASE WHEN k % 6 = 0 THEN 'service_authenticated'
    ELSE 'legacy_no_ingested_by' END AS provenance FROM ev""",
)
def provenance(spark, sf_dir):
    return G.provenance_listing(records(spark, sf_dir).withColumn("payload_v", F.try_parse_json("payload")))


@query(
    "ing_framework_lifecycle",
    """WITH i AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'held' END AS why,
    CASE WHEN o_orderstatus = 'F' THEN 'success' END AS ack FROM orders),
    s AS (SELECT id, 'tool.execution.requested' AS event_type, 'requested' AS stage FROM i UNION ALL
    SELECT id, 'tool.execution.not_dispatched', 'not_dispatched' FROM i WHERE why IS NOT NULL UNION ALL
    SELECT id, 'tool.execution.dispatched', 'dispatched' FROM i WHERE why IS NULL UNION ALL
    SELECT id, 'tool.execution.acknowledged', 'acknowledged' FROM i WHERE why IS NULL AND ack IS NOT NULL)
    SELECT 'framework:graph:' || id || ':' || stage AS idempotency_key, event_type, id || ':' || stage AS sort_key FROM s""",
)
def framework_lifecycle(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(
        F.lit("graph").alias("framework"),
        F.col("o_orderkey").cast("string").alias("invocation_id"),
        F.when(F.col("o_orderstatus") == "P", "held").alias("not_dispatched_reason"),
        F.when(F.col("o_orderstatus") == "F", "success").alias("acknowledgement_status"),
    )
    return G.framework_lifecycle(df).select("idempotency_key", "event_type", "sort_key")


def descriptors(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    null = F.lit(None).cast("string")
    empty = F.create_map().cast("map<string,string>")
    protocol = G.descriptor_hash(
        server_identity=F.col("p_brand"),
        name=F.col("p_name"),
        description=F.col("p_type"),
        input_schema=F.struct(F.col("p_size").alias("size")),
        output_schema=null,
        annotations=empty,
        metadata=empty,
    )
    framework = G.descriptor_hash(
        "framework",
        framework=F.lit("graph"),
        tool_name=F.col("p_name"),
        description=F.col("p_type"),
        input_schema=F.struct(F.col("p_size").alias("size")),
        output_schema=null,
        annotations=empty,
        metadata=empty,
        version=F.lit("2"),
    )
    return df.select(
        "p_partkey", "p_brand", "p_name", protocol.alias("descriptor_hash"), framework.alias("framework_hash")
    )


_DESC = """d AS (SELECT p_partkey, p_brand, p_name, 'sha256:' || sha256('{"adapter":"mcp","annotations":{},"description":"'
 || p_type || '","input_schema":{"size":' || p_size || '},"metadata":{},"name":"' || p_name
 || '","output_schema":null,"server_identity":"' || p_brand || '"}') AS descriptor_hash,
 'sha256:' || sha256('{"adapter":"framework","annotations":{},"description":"' || p_type
 || '","framework":"graph","input_schema":{"size":' || p_size || '},"metadata":{},"output_schema":null,"tool_name":"'
 || p_name || '","version":"2"}') AS framework_hash FROM part)"""


@query(
    "ing_descriptor_hash", f"WITH {_DESC} SELECT p_partkey, descriptor_hash, framework_hash FROM d"
)
def descriptor_hash(spark, sf_dir):
    return descriptors(spark, sf_dir).select("p_partkey", "descriptor_hash", "framework_hash")


@query(
    "ing_descriptor_drift",
    f"""WITH {_DESC}, l AS (SELECT *, lag(descriptor_hash) OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey)
    AS previous_hash FROM d) SELECT p_partkey, previous_hash, descriptor_hash, previous_hash <> descriptor_hash
    AS changed FROM l WHERE previous_hash IS NOT NULL""",
)
def descriptor_drift(spark, sf_dir):
    rows = G.descriptor_drift(descriptors(spark, sf_dir), ["p_brand", "p_name"], ["p_partkey"])
    return rows.select("p_partkey", "previous_hash", "descriptor_hash", "changed")


# Orders as calls: the priority gives the policy outcome, the status the approval.
_CALL = """c AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'allow' WHEN '2-HIGH' THEN 'dry_run'
 WHEN '3-MEDIUM' THEN 'require_approval' WHEN '5-LOW' THEN 'error' ELSE 'deny' END AS outcome,
 CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'P' THEN 'rejected' END AS approval_status,
 CASE WHEN o_custkey % 2 = 0 THEN 'fail_open' ELSE 'fail_closed' END AS failure_mode FROM orders),
 g AS (SELECT *, CASE WHEN outcome IN ('allow', 'dry_run') THEN true WHEN outcome = 'require_approval'
 THEN coalesce(approval_status = 'accepted', false) WHEN outcome = 'error' THEN failure_mode = 'fail_open'
 ELSE false END AS go FROM c)"""


def calls(spark, sf_dir):
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(priority == "1-URGENT", "allow")
        .when(priority == "2-HIGH", "dry_run")
        .when(priority == "3-MEDIUM", "require_approval")
        .when(priority == "5-LOW", "error")
        .otherwise("deny")
        .alias("outcome"),
        F.when(status == "F", "accepted").when(status == "P", "rejected").alias("approval_status"),
        F.when(F.col("o_custkey") % 2 == 0, "fail_open").otherwise("fail_closed").alias("failure_mode"),
    )


@query("ing_policy_dispatch_decision", f"WITH {_CALL} SELECT o_orderkey, outcome, go AS allowed FROM g")
def policy_dispatch(spark, sf_dir):
    return calls(spark, sf_dir).select(
        "o_orderkey",
        "outcome",
        G.dispatch_allowed(
            F.col("outcome"), F.col("approval_status") == "accepted", F.col("failure_mode")
        ).alias("allowed"),
    )


@query(
    "ing_mcp_plan_events",
    f"""WITH {_CALL}, s AS (SELECT *, unnest([{{'step': 0, 'stage': 'requested'}}, {{'step': 1, 'stage': 'policy'}},
    {{'step': 2, 'stage': 'authorized'}}, {{'step': 3, 'stage': 'dispatched'}},
    {{'step': 4, 'stage': 'not_dispatched'}}, {{'step': 5, 'stage': 'degraded'}}]) AS e FROM g)
    SELECT o_orderkey, e.step::BIGINT AS step, e.stage AS stage, CASE WHEN e.stage = 'not_dispatched' THEN CASE WHEN
    approval_status = 'rejected' THEN 'approval_rejected' ELSE 'policy_' || outcome END END AS reason FROM s
    WHERE e.step < 2 OR (e.step IN (2, 3) AND go) OR (e.step = 4 AND NOT go) OR (e.step = 5 AND outcome = 'error')""",
)
def mcp_plan(spark, sf_dir):
    return G.plan_events(calls(spark, sf_dir)).select("o_orderkey", "step", "stage", "reason")


@query(
    "ing_approval_claims",
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey % 500 AS nonce,
    row_number() OVER (PARTITION BY l_orderkey % 500 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS attempt,
    l_returnflag = 'A' AND l_linestatus = 'F' AND l_shipdate <= TIMESTAMP '1999-01-01' AS valid FROM lineitem),
    t AS (SELECT *, coalesce(max(CASE WHEN valid THEN 1 ELSE 0 END) OVER (PARTITION BY nonce ORDER BY attempt
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM a)
    SELECT nonce, attempt, CASE WHEN used = 0 AND valid THEN 'accepted' ELSE 'rejected' END AS status,
    CASE WHEN used = 1 THEN 'nonce_spent' WHEN valid THEN 'approval_ok'
    ELSE 'approval_invalid' END AS reason FROM t""",
)
def approval_claims(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        "*",
        (F.col("l_orderkey") % 500).alias("nonce"),
        G.approval_valid(
            F.col("l_returnflag"),
            F.lit("A"),
            F.col("l_linestatus"),
            F.lit("F"),
            F.lit("1999-01-01").cast("timestamp_ntz"),
            F.col("l_shipdate"),
        ).alias("valid"),
    )
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    from witspark.operators.ordered import in_order

    numbered = in_order(df, ["nonce"], order, {"attempt": ("row_number", None)})
    return G.approval_claims(numbered).select("nonce", "attempt", "status", "reason")


@query(
    "ing_tenant_access_decision",
    """WITH q AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'no such/tenant' ELSE n_name END AS tenant_id,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'read' WHEN 'MACHINERY' THEN 'write' WHEN 'HOUSEHOLD' THEN 'export'
    WHEN 'AUTOMOBILE' THEN 'admin' ELSE 'read' END AS need, CASE c_custkey % 4 WHEN 0 THEN ['read'] WHEN 1 THEN
    ['read', 'write', 'export'] WHEN 2 THEN ['admin'] ELSE [] END AS own, CASE WHEN c_custkey % 3 = 0 THEN []
    WHEN c_custkey % 5 = 0 THEN ['admin'] ELSE ['read', 'export'] END AS bound
    FROM customer JOIN nation ON n_nationkey = c_nationkey),
    g AS (SELECT *, list_contains(own, need) OR list_contains(own, 'admin') AS by_own,
    list_contains(bound, need) OR list_contains(bound, 'admin') AS by_bound FROM q),
    r AS (SELECT *, CASE WHEN tenant_id = 'no such/tenant' THEN 'tenant_unknown' WHEN NOT by_own THEN
    'principal_role_missing' WHEN by_bound THEN 'tenant_role_granted' ELSE 'tenant_binding_missing' END AS reason FROM g)
    SELECT 'customer_' || c_custkey AS principal_id, tenant_id, need AS required_role,
    reason = 'tenant_role_granted' AS allowed, reason FROM r""",
)
def tenant_decision(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    principal = F.concat(F.lit("customer_"), key).alias("principal_id")
    segment = F.col("c_mktsegment")
    requests = customer.select(
        principal,
        F.when(key % 11 == 0, "no such/tenant").otherwise(F.col("n_name")).alias("tenant_id"),
        F.when(segment == "BUILDING", "read")
        .when(segment == "MACHINERY", "write")
        .when(segment == "HOUSEHOLD", "export")
        .when(segment == "AUTOMOBILE", "admin")
        .otherwise("read")
        .alias("required_role"),
    )

    def roles(*names):
        return F.array(*[F.lit(n) for n in names]).cast("array<string>")

    principals = customer.select(
        principal,
        F.when(key % 4 == 0, roles("read"))
        .when(key % 4 == 1, roles("read", "write", "export"))
        .when(key % 4 == 2, roles("admin"))
        .otherwise(roles())
        .alias("roles"),
    )
    bindings = customer.filter("c_custkey % 3 <> 0").select(
        F.col("n_name").alias("tenant_id"),
        principal,
        F.when(key % 5 == 0, roles("admin")).otherwise(roles("read", "export")).alias("roles"),
    )
    tenants = nation.select(F.col("n_name").alias("tenant_id"))
    return G.tenant_decisions(requests, tenants, principals, bindings)
