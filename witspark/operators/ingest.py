"""Records from sources, idempotent import, lifecycle expansion and access decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from witspark import schema as S
from witspark.functions.digest import sha256_label, sorted_json
from witspark.functions.payload import kind_of, variant_at
from witspark.operators.ordered import in_order

FINGERPRINT_VERSION = f"{S.NAMESPACE}/record-fingerprint-v1"
PROVENANCE_VERSION = f"{S.NAMESPACE}/ingestion-provenance-v1"
RECORD_COLUMNS = ("idempotency_key", "event_type", "source_kind", "sort_key", "payload")

# Capabilities of each service role.
ROLE_CAPABILITIES = {
    "read": ("events:read", "journal:verify", "cases:read"),
    "write": ("events:write", "journal:verify", "projections:rebuild"),
    "export": ("cases:export",),
    "admin": (
        "events:read",
        "events:write",
        "journal:verify",
        "projections:rebuild",
        "detections:run",
        "cases:read",
        "cases:export",
        "admin:configure",
        "tenants:manage",
    ),
}


def _record(df: DataFrame, event_type: str, payload: Column) -> DataFrame:
    def given(name, default):
        return F.col(name) if name in df.columns else F.lit(default)

    return df.select(
        "idempotency_key",
        given("event_type", event_type).alias("event_type"),
        given("source_kind", "unknown").alias("source_kind"),
        given("sort_key", "").alias("sort_key"),
        F.to_json(payload).alias("payload"),
    )


def records_from_actions(df: DataFrame) -> DataFrame:
    """Records of normalized actions; null members are left out of the payload."""

    action = F.struct(
        "action_type", "resources", "tool_identity", "delegated_identity", "attributes"
    )
    return _record(df, "action.normalized", F.struct(action.alias("action")))


def records_from_observations(df: DataFrame) -> DataFrame:
    """Records of observations: observer, resource, state, status and limitations."""

    return _record(
        df,
        "side_effect.observed",
        F.struct(
            "observer_identity", "resource", "observed_state", "verification_status", "limitations"
        ),
    )


def records_from_verifications(df: DataFrame) -> DataFrame:
    """Records that wrap an evidence link."""

    return _record(df, "side_effect.verified", F.struct("evidence_link"))


def link_errors(link: Column) -> Column:
    """Array of what is wrong with an evidence link struct."""

    limits = F.coalesce(link["limitations"], F.array().cast("array<string>"))
    checks = [
        ("subject_event_id", link["subject_event_id"].isNull()),
        ("evidence_event_id", link["evidence_event_id"].isNull()),
        ("observer_identity", link["observer_identity"].isNull()),
        ("relationship", ~F.coalesce(link["relationship"].isin(*S.RELATIONSHIPS), F.lit(False))),
        (
            "corroboration_type",
            ~F.coalesce(link["corroboration_type"].isin(*S.CORROBORATION_TYPES), F.lit(False)),
        ),
        (
            "verification_status",
            ~F.coalesce(link["verification_status"].isin(*S.STATUSES), F.lit(False)),
        ),
        ("confidence", ~F.coalesce(link["confidence"].between(0.0, 1.0), F.lit(False))),
        ("limitations", F.exists(limits, lambda x: x.isNull() | (x == ""))),
    ]
    found = F.array(*[F.when(bad, F.lit(name)) for name, bad in checks])
    return F.filter(found, lambda e: e.isNotNull())


def validate_links(df: DataFrame) -> DataFrame:
    """Events with a link, and the faulty members of it."""

    return df.filter("evidence_link IS NOT NULL").select(
        "event_id", link_errors(F.col("evidence_link")).alias("errors")
    )


def _fingerprint_payload(payload: Column) -> Column:
    """Payload text without the ingest member and without service-made provenance."""

    value = F.try_parse_json(payload)
    members = F.try_variant_get(value, "$", "map<string,variant>")
    version = F.try_variant_get(value, "$.ingested_by.schema_version", "string")
    ours = F.coalesce(version == PROVENANCE_VERSION, F.lit(False))
    kept = F.map_filter(
        members, lambda k, _v: (k != "ingest") & ~((k == "ingested_by") & ours)
    )
    return F.to_json(kept)


def record_fingerprint(df: DataFrame, context: dict[str, Column]) -> DataFrame:
    """Add `fingerprint`: a digest of the record in its normalizer's context.

    `context` gives JSON texts for classification, correlation, principal and source.
    """

    def member(name, text):
        return F.concat(F.lit(f'"{name}":'), text)

    def quoted(col):
        return F.regexp_extract(F.to_json(F.array(col)), r"(?s)^\[(.*)\]$", 1)

    text = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            member("classification", context["classification"]),
            member("correlation", context["correlation"]),
            member("event_type", quoted("event_type")),
            member("idempotency_key", quoted("idempotency_key")),
            member("payload", _fingerprint_payload(F.col("payload"))),
            member("principal", context["principal"]),
            member("sort_key", quoted("sort_key")),
            member("source", context["source"]),
            member("source_kind", quoted("source_kind")),
            member("version", F.lit(f'"{FINGERPRINT_VERSION}"')),
        ),
        F.lit("}"),
    )
    return df.withColumn("fingerprint", sha256_label(text))


def import_batch(records: DataFrame, existing: DataFrame) -> DataFrame:
    """Outcome of each record: imported, duplicate, conflict or failed.

    `records`: idempotency_key, sort_key, arrival, fingerprint, event_id, valid.
    `existing`: idempotency_key, event_id, fingerprint, position; the last
    entry of a key counts. The first valid use of a key imports it; a failed
    record does not claim its key. The claim of a key is found by an aggregate
    that combines before the shuffle, and joined back, so that a key used by a
    third of all records needs no window of its own.
    """

    place = F.struct("sort_key", "idempotency_key", "arrival")
    claims = (
        records.filter("valid")
        .groupBy("idempotency_key")
        .agg(F.min_by(F.struct(place.alias("at"), "event_id", "fingerprint"), place).alias("claim"))
    )
    stored = existing.groupBy("idempotency_key").agg(
        F.max_by(F.struct("event_id", "fingerprint"), "position").alias("stored")
    )
    # One entry per key first: the records meet it in a single join, whose popular
    # keys Spark can split as nothing above it needs them together.
    entries = claims.join(stored, "idempotency_key", "full")
    joined = records.join(entries, "idempotency_key", "left")
    claim, old = F.col("claim"), F.col("stored")
    earlier = claim.isNotNull() & (claim["at"] < place)
    entry = F.when(old.isNotNull(), old).when(
        earlier,
        F.struct(claim["event_id"].alias("event_id"), claim["fingerprint"].alias("fingerprint")),
    )
    same = entry["fingerprint"].isNull() | (entry["fingerprint"] == F.col("fingerprint"))
    status = (
        F.when(entry.isNotNull(), F.when(same, "duplicate").otherwise("conflict"))
        .when(F.col("valid"), "imported")
        .otherwise("failed")
    )
    return joined.select(
        "idempotency_key",
        "arrival",
        status.alias("status"),
        F.when(entry.isNotNull(), entry["event_id"])
        .when(F.col("valid"), F.col("event_id"))
        .alias("event_id"),
        F.when(status == "conflict", "key_claimed_by_other")
        .when(status == "failed", "not_importable")
        .alias("error"),
    )


def import_summary(outcomes: DataFrame, by=()) -> DataFrame:
    """Counts per outcome, and ok if nothing failed or conflicted."""

    counts = outcomes.groupBy(*by).agg(
        *[
            F.count_if(F.col("status") == name).alias(name)
            for name in ("imported", "duplicate", "conflict", "failed")
        ]
    )
    return counts.withColumn("ok", (F.col("failed") == 0) & (F.col("conflict") == 0))


def assign_causality(df: DataFrame, keys, order, initial: int = 0) -> DataFrame:
    """Add sequence, parent_event_id and root_event_id per group in the given order."""

    numbered = in_order(
        df,
        list(keys),
        list(order),
        {
            "__position": ("row_number", None),
            "parent_event_id": ("lag", "event_id"),
            "root_event_id": ("first", "event_id"),
        },
    )
    return numbered.withColumn("sequence", F.col("__position") - 1 + initial).drop("__position")


def stamp_ingest(df: DataFrame, principal: Column, roles: Column, request_id: Column) -> DataFrame:
    """Add `ingest` and `ingested_by`; `rejected` marks rows that brought their own provenance."""

    supplied = variant_at(F.col("payload_v"), "ingested_by").isNotNull()
    return df.select(
        "*",
        F.struct(
            F.lit(FINGERPRINT_VERSION).alias("fingerprint_version"),
            "idempotency_key",
            F.col("fingerprint").alias("record_fingerprint"),
            "source_kind",
        ).alias("ingest"),
        F.when(
            ~supplied,
            F.struct(
                F.lit(PROVENANCE_VERSION).alias("schema_version"),
                principal.alias("authenticated_principal"),
                F.array_sort(roles).alias("authenticated_roles"),
                F.concat(F.lit("principal:"), principal).alias("credential_identifier"),
                request_id.alias("request_id"),
                F.lit(False).alias("legacy"),
            ),
        ).alias("ingested_by"),
        supplied.alias("rejected"),
    )


def capabilities_of(roles: Column) -> Column:
    """All capabilities that an array of role names grants."""

    table = F.create_map(
        *[
            item
            for role, caps in ROLE_CAPABILITIES.items()
            for item in (F.lit(role), F.array(*[F.lit(c) for c in caps]))
        ]
    )
    empty = F.array().cast("array<string>")
    return F.array_distinct(
        F.flatten(F.transform(roles, lambda r: F.coalesce(F.try_element_at(table, r), empty)))
    )


def guard_trusted(df: DataFrame, principals: DataFrame) -> DataFrame:
    """Rows that claim trust without the admin capability: (event_id, principal_id)."""

    able = principals.select(
        "principal_id",
        F.array_contains(capabilities_of(F.col("roles")), "admin:configure").alias("admin"),
    )
    claims = df.filter(F.col("trust") == "trusted")
    joined = claims.join(able, "principal_id", "left")
    return joined.filter(~F.coalesce("admin", F.lit(False))).select("event_id", "principal_id")


def provenance_listing(df: DataFrame) -> DataFrame:
    """Per event whether an authenticated service stamped it."""

    stamped = F.coalesce(
        kind_of(variant_at(F.col("payload_v"), "ingested_by")) == "OBJECT", F.lit(False)
    )
    return df.select(
        "event_id",
        F.when(stamped, "service_authenticated").otherwise("legacy_no_ingested_by").alias(
            "provenance"
        ),
    )


def _steps(df: DataFrame, steps) -> DataFrame:
    """Explode (event type, stage, condition) steps of each row in order."""

    entries = F.array(
        *[
            F.when(
                keep,
                F.struct(
                    F.lit(i).cast("bigint").alias("step"),
                    F.lit(kind).alias("event_type"),
                    F.lit(stage).alias("stage"),
                ),
            )
            for i, (kind, stage, keep) in enumerate(steps)
        ]
    )
    return df.select(
        "*", F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("__s")
    ).select("*", "__s.*").drop("__s")


def framework_lifecycle(df: DataFrame) -> DataFrame:
    """Requested, then not dispatched, or dispatched and perhaps acknowledged.

    Needs framework, invocation_id, acknowledgement_status, not_dispatched_reason.
    """

    stopped = F.col("not_dispatched_reason").isNotNull()
    rows = _steps(
        df,
        [
            ("tool.execution.requested", "requested", F.lit(True)),
            ("tool.execution.not_dispatched", "not_dispatched", stopped),
            ("tool.execution.dispatched", "dispatched", ~stopped),
            (
                "tool.execution.acknowledged",
                "acknowledged",
                ~stopped & F.col("acknowledgement_status").isNotNull(),
            ),
        ],
    )
    return rows.withColumn(
        "idempotency_key",
        F.concat_ws(":", F.lit("framework"), "framework", "invocation_id", "stage"),
    ).withColumn("sort_key", F.concat_ws(":", "invocation_id", "stage"))


def descriptor_hash(shape: str = "protocol", **fields: Column) -> Column:
    """Identity digest of a tool descriptor.

    Shape protocol: server_identity, name, description, input_schema,
    output_schema, annotations, metadata. Shape framework: framework,
    tool_name, and the same; server_identity and version only if given.
    """

    fixed = {"adapter": F.lit("mcp" if shape == "protocol" else "framework")}
    return sha256_label(sorted_json(**fixed, **fields))


def descriptor_drift(df: DataFrame, keys, order, digest: str = "descriptor_hash") -> DataFrame:
    """Each later version of a descriptor with the digest before it and whether it changed."""

    rows = in_order(df, list(keys), list(order), {"previous_hash": ("lag", digest)})
    return rows.filter("previous_hash IS NOT NULL").withColumn(
        "changed", F.col("previous_hash") != F.col(digest)
    )


def dispatch_allowed(outcome: Column, approval: Column, failure_mode: Column) -> Column:
    """Whether a policy outcome lets a call go out."""

    return F.coalesce(
        F.when(outcome.isin("allow", "dry_run"), F.lit(True))
        .when(outcome == "require_approval", approval)
        .when(outcome == "error", failure_mode == "fail_open"),
        F.lit(False),
    )


def approval_claims(df: DataFrame) -> DataFrame:
    """Status and reason of each approval attempt.

    Needs nonce, attempt (strict order inside a nonce), and `valid`. The first
    valid attempt takes the nonce; attempts after it find it used.
    """

    taken = df.filter("valid").groupBy("nonce").agg(F.min("attempt").alias("taken_at"))
    joined = df.join(taken, "nonce", "left")
    used = F.coalesce(F.col("attempt") > F.col("taken_at"), F.lit(False))
    accepted = ~used & F.col("valid")
    return joined.select(
        *df.columns,
        F.when(accepted, "accepted").otherwise("rejected").alias("status"),
        F.when(used, "nonce_spent")
        .when(accepted, "approval_ok")
        .otherwise("approval_invalid")
        .alias("reason"),
    )


def approval_valid(scope, wanted_scope, subject, wanted_subject, expires_at, now) -> Column:
    """Whether an approval fits the request at its time."""

    return F.coalesce(
        (scope == wanted_scope) & (subject == wanted_subject) & (expires_at >= now), F.lit(False)
    )


def plan_events(df: DataFrame) -> DataFrame:
    """Lifecycle events of each call decision, in order, with the reason of a stop.

    Needs outcome, failure_mode, approval_status (accepted, rejected or null).
    """

    approved = F.coalesce(F.col("approval_status") == "accepted", F.lit(False))
    go = dispatch_allowed(F.col("outcome"), approved, F.col("failure_mode"))
    reason = F.when(
        F.col("approval_status").isNotNull() & ~approved, "approval_rejected"
    ).otherwise(F.concat(F.lit("policy_"), F.col("outcome")))
    rows = _steps(
        df,
        [
            ("tool.execution.requested", "requested", F.lit(True)),
            ("policy.decision", "policy", F.lit(True)),
            ("tool.execution.authorized", "authorized", go),
            ("tool.execution.dispatched", "dispatched", go),
            ("tool.execution.not_dispatched", "not_dispatched", ~go),
            ("recorder.degraded", "degraded", F.col("outcome") == "error"),
        ],
    )
    return rows.withColumn("reason", F.when(F.col("stage") == "not_dispatched", reason))


TENANT_ID = r"^[A-Za-z0-9._-]{1,128}$"


def valid_tenant_id(col: Column) -> Column:
    """A tenant id is one portable path segment of at most 128 safe characters."""

    return col.rlike(TENANT_ID) & ~col.isin(".", "..")


def tenant_decisions(
    requests: DataFrame, tenants: DataFrame, principals: DataFrame, bindings: DataFrame
) -> DataFrame:
    """Allowed or not, with the reason, for (principal_id, tenant_id, required_role) requests."""

    def grants(roles):
        missing = F.array_except(
            capabilities_of(F.array("required_role")), capabilities_of(roles)
        )
        return F.size(missing) == 0

    known = tenants.select("tenant_id", F.lit(True).alias("known")).distinct()
    held = principals.select("principal_id", F.col("roles").alias("own_roles"))
    # A binding grants a role by itself, so each keeps its own role set.
    bound = bindings.groupBy("tenant_id", "principal_id").agg(
        F.collect_set("roles").alias("role_sets")
    )
    joined = (
        requests.join(known, "tenant_id", "left")
        .join(held, "principal_id", "left")
        .join(bound, ["tenant_id", "principal_id"], "left")
    )
    empty = F.array().cast("array<string>")
    own = grants(F.coalesce("own_roles", empty))
    through = F.exists(
        F.coalesce("role_sets", F.array().cast("array<array<string>>")), grants
    )
    reason = (
        F.when(F.col("known").isNull() | ~valid_tenant_id(F.col("tenant_id")), "tenant_unknown")
        .when(~own, "principal_role_missing")
        .when(through, "tenant_role_granted")
        .otherwise("tenant_binding_missing")
    )
    return joined.select(
        *requests.columns, (reason == "tenant_role_granted").alias("allowed"), reason.alias("reason")
    )
