"""Contract checks over many scopes (runs, traces, journals) at once.

Every check returns violation rows: the scope columns, contract, code,
event_id, event_type, field and severity. A scope without rows is sound.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from witspark.functions.payload import Resolver, variant_at
from witspark.operators.ordered import in_order


@dataclass(frozen=True)
class EventRequirement:
    event_type: str
    fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class Relationship:
    child: str
    parent: str
    reference: str | None = None


@dataclass(frozen=True)
class LinkRequirement:
    event_type: str = "side_effect.verified"
    subject_type: str | None = None
    evidence_type: str | None = None
    relationship: str | None = None
    status: str | None = None
    corroboration_types: tuple[str, ...] = ()
    observer: str | None = None


@dataclass(frozen=True)
class Latency:
    start: str
    end: str
    max_seconds: float
    group_by: tuple[str, ...] = ("correlation.run_id",)


@dataclass(frozen=True)
class Descriptor:
    event_type: str
    hash_field: str = "payload.tool_identity.descriptor_hash"
    name_field: str = "payload.tool_identity.name"
    prefix: str = "sha256:"


@dataclass(frozen=True)
class DetectionRequirement:
    rule_id: str
    required: bool = True
    event_types: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()


@dataclass(frozen=True)
class Contract:
    name: str
    events: tuple[EventRequirement, ...] = ()
    relationships: tuple[Relationship, ...] = ()
    links: tuple[LinkRequirement, ...] = ()
    latency: tuple[Latency, ...] = ()
    descriptors: tuple[Descriptor, ...] = ()
    detections: tuple[DetectionRequirement, ...] = ()
    allowed_statuses: tuple[str, ...] = ()
    required_status: str | None = None
    hash_chain_required: bool = True


def contract_from_dict(data: dict) -> Contract:
    """Contract from its parsed JSON form."""

    spec = data.get("spec", data)
    needs = spec.get("requirements", spec)
    verification = needs.get("verification", {})
    return Contract(
        name=data.get("metadata", data).get("name"),
        events=tuple(
            EventRequirement(e["type"], tuple(e.get("requiredFields", ())))
            for e in needs.get("events", ())
        ),
        relationships=tuple(
            Relationship(r["child"], r["parent"], r.get("referenceField"))
            for r in needs.get("relationships", ())
        ),
        links=tuple(
            LinkRequirement(
                k.get("eventType", "side_effect.verified"),
                k.get("subjectEventType"),
                k.get("evidenceEventType"),
                k.get("relationship"),
                k.get("verificationStatus"),
                tuple(k.get("corroborationTypes", ())),
                k.get("observerIdentity"),
            )
            for k in needs.get("evidenceLinks", ())
        ),
        latency=tuple(
            Latency(
                t["startEventType"],
                t["endEventType"],
                float(t["maxSeconds"]),
                tuple(t.get("groupBy", ("correlation.run_id",))),
            )
            for t in needs.get("latency", ())
        ),
        descriptors=tuple(Descriptor(d["eventType"]) for d in needs.get("descriptors", ())),
        detections=tuple(
            DetectionRequirement(
                d["ruleId"],
                d.get("required", True),
                tuple(d.get("requiredEventTypes", ())),
                tuple(d.get("requiredVerificationStatuses", ())),
            )
            for d in needs.get("detections", ())
        ),
        allowed_statuses=tuple(verification.get("allowedStatuses", ())),
        required_status=verification.get("requiredStatus"),
        hash_chain_required=needs.get("integrity", {}).get("hashChainRequired", True),
    )


STATUS_FIELD = "payload.evidence_link.verification_status"

SHAPE = ("code", "event_id", "event_type", "field")


def _issue(code, event_id=None, event_type=None, field=None) -> Column:
    def text(value):
        if isinstance(value, Column):
            return value.cast("string")
        return F.lit(value).cast("string")

    return F.struct(
        text(code).alias("code"),
        text(event_id).alias("event_id"),
        text(event_type).alias("event_type"),
        text(field).alias("field"),
    )


def _spread(df: DataFrame, by, *issues: Column) -> DataFrame:
    """One row per non-null issue struct."""

    found = F.filter(F.array(*issues), lambda i: i.isNotNull())
    return df.select(*by, F.explode(found).alias("i")).select(*by, "i.*")


def exact_text(path: str) -> Column:
    """Text of an envelope column or payload path, without the payload retry of rules."""

    find = Resolver()
    if path.startswith("payload."):
        return find.text(path)
    column = find.envelope(path)
    return F.lit("") if column is None else F.coalesce(column.cast("string"), F.lit(""))


def _nonempty(path: str) -> Column:
    if path.startswith("payload."):
        value = variant_at(F.col("payload_v"), path.removeprefix("payload."))
        return F.coalesce(~F.to_json(value).isin('""', "[]", "{}"), F.lit(False))
    return exact_text(path) != ""


def _any(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def _has_status(status: str) -> Column:
    link = F.col("evidence_link.verification_status")
    return F.coalesce(link == status, F.lit(False)) | F.coalesce(
        F.col("payload_status") == status, F.lit(False)
    )


def check_presence(df: DataFrame, contract: Contract, by) -> DataFrame:
    """Missing events, fields and required status: one aggregate over all requirements."""

    aggregates, issues = [], []
    for i, need in enumerate(contract.events):
        is_type = F.col("event_type") == need.event_type
        aggregates.append(_any(is_type).alias(f"e{i}"))
        issues.append(
            F.when(~F.col(f"e{i}"), _issue("required_event_missing", event_type=need.event_type))
        )
        for j, path in enumerate(need.fields):
            aggregates.append(_any(is_type & _nonempty(path)).alias(f"f{i}_{j}"))
            issues.append(
                F.when(
                    F.col(f"e{i}") & ~F.col(f"f{i}_{j}"),
                    _issue("required_field_missing", event_type=need.event_type, field=path),
                )
            )
    if contract.required_status is not None:
        aggregates.append(_any(_has_status(contract.required_status)).alias("status"))
        issues.append(
            F.when(
                ~F.col("status"),
                _issue(
                    "verification_status_missing",
                    field="payload.evidence_link.verification_status",
                ),
            )
        )
    return _spread(df.groupBy(*by).agg(*aggregates), by, *issues)


def check_allowed_statuses(df: DataFrame, contract: Contract, by) -> DataFrame:
    """Statuses outside the allowed set, from links and payloads alike."""

    both = F.array("evidence_link.verification_status", "payload_status")
    found = df.select(*by, F.explode(both).alias("field")).filter("field IS NOT NULL")
    odd = found.filter(~F.col("field").isin(*contract.allowed_statuses)).distinct()
    return odd.select(
        *by,
        F.lit("verification_status_not_allowed").alias("code"),
        F.lit(None).cast("string").alias("event_id"),
        F.lit(None).cast("string").alias("event_type"),
        "field",
    )


def check_relationship(df: DataFrame, need: Relationship, by) -> DataFrame:
    """Scopes in which no child of the type has a parent of the type."""

    parent_id = (
        F.col("parent_event_id")
        if need.reference is None
        else F.nullif(exact_text(need.reference), F.lit(""))
    )
    wanted = (
        df.filter(F.col("event_type") == need.child)
        .select(*by, parent_id.alias("event_id"))
        .filter("event_id IS NOT NULL")
        .distinct()
    )
    parents = df.filter(F.col("event_type") == need.parent).select(*by, "event_id")
    met = wanted.join(parents, [*by, "event_id"], "left_semi").select(*by).distinct()
    missing = df.select(*by).distinct().join(met, list(by), "left_anti")
    issue = _issue("relationship_missing", event_type=need.child, field=need.reference)
    return missing.select(*by, issue.alias("i")).select(*by, "i.*")


def check_links(df: DataFrame, need: LinkRequirement, by) -> DataFrame:
    """Evidence-link faults of the events of one type; the first kind of fault ends a row."""

    absent = (
        df.groupBy(*by)
        .agg(_any(F.col("event_type") == need.event_type).alias("there"))
        .filter(~F.col("there"))
    )
    absent = _spread(
        absent, by, _issue("evidence_link_event_missing", event_type=need.event_type)
    )
    rows = _link_rows(df, [need], by)
    return _spread(rows, by, *_link_issues_of(need)).unionByName(absent)


def check_latency(df: DataFrame, need: Latency, by) -> DataFrame:
    """End events whose nearest start, before or after, lies too far away.

    The nearest start is carried along the ordered group from both sides, so no
    end meets more than two starts.
    """

    is_start, is_end = F.col("event_type") == need.start, F.col("event_type") == need.end
    presence = df.groupBy(*by).agg(_any(is_start).alias("starts"), _any(is_end).alias("ends"))
    missing = _spread(
        presence.filter(~(F.col("starts") & F.col("ends"))),
        by,
        _issue("latency_event_missing", event_type=need.end),
    )
    return _latency_rows(df, need, by).unionByName(missing)


def _latency_rows(df: DataFrame, need: Latency, by) -> DataFrame:
    """Ends without a start in their group, or too far from the nearest one.

    Scopes without any start have no row here: they lack the event altogether.
    """

    is_start, is_end = F.col("event_type") == need.start, F.col("event_type") == need.end
    groups = [f"__g{i}" for i in range(len(need.group_by))]
    rows = df.filter(is_start | is_end).select(
        *by,
        *[exact_text(p).alias(g) for p, g in zip(need.group_by, groups)],
        "event_id",
        "event_type",
        F.unix_micros("occurred_at").alias("us"),
        F.when(is_start, F.unix_micros("occurred_at")).alias("start_us"),
    )
    keys = [*by, *groups]
    near = in_order(
        rows,
        keys,
        ["us", "event_id"],
        {"before": ("carry_forward", "start_us"), "after": ("carry_back", "start_us")},
    )
    gap = F.least(F.col("us") - F.col("before"), F.col("after") - F.col("us"))
    ends = near.filter(is_end).withColumn("gap", gap)
    ends = ends.join(df.filter(is_start).select(*by).distinct(), list(by), "left_semi")
    limit = round(need.max_seconds * 1_000_000)
    return _spread(
        ends,
        by,
        F.when(
            F.col("gap").isNull(),
            _issue("latency_start_missing", F.col("event_id"), F.col("event_type")),
        ),
        F.when(
            F.col("gap") > limit,
            _issue("latency_breach", F.col("event_id"), F.col("event_type"), "occurred_at"),
        ),
    )


def check_descriptor(df: DataFrame, need: Descriptor, by) -> DataFrame:
    """Events of a type without tool name and descriptor hash, or with an odd hash."""

    is_type = F.col("event_type") == need.event_type
    absent = df.groupBy(*by).agg(_any(is_type).alias("there")).filter(~F.col("there"))
    absent = _spread(absent, by, _issue("descriptor_event_missing", event_type=need.event_type))
    return _spread(df.filter(is_type), by, *_descriptor_issues(need)).unionByName(absent)


def _descriptor_issues(need: Descriptor) -> list[Column]:
    wanted = F.col("event_type") == need.event_type
    digest = exact_text(need.hash_field)
    unknown = (exact_text(need.name_field) == "") | (digest == "")

    def issue(code):
        return _issue(code, F.col("event_id"), F.col("event_type"), need.hash_field)

    return [
        F.when(wanted & unknown, issue("descriptor_identity_missing")),
        F.when(wanted & ~unknown & ~F.startswith(digest, F.lit(need.prefix)), issue("descriptor_hash_invalid")),
    ]


def check_detection(
    df: DataFrame, matches: DataFrame, need: DetectionRequirement, by
) -> DataFrame:
    """Missing matches of a rule, or matches without the events and statuses they rest on.

    `matches` holds the scope columns and rule_id.
    """

    parts = [F.count(F.lit(1)).alias("n")]
    for i, kind in enumerate(need.event_types):
        parts.append(_any(F.col("event_type") == kind).alias(f"t{i}"))
    for i, status in enumerate(need.statuses):
        parts.append(_any(_has_status(status)).alias(f"s{i}"))
    hits = matches.filter(F.col("rule_id") == need.rule_id).select(*by).distinct()
    scopes = df.groupBy(*by).agg(*parts)
    scopes = scopes.join(hits.withColumn("hit", F.lit(True)), list(by), "left")
    hit = F.coalesce("hit", F.lit(False))
    code = "detection_control_dependency_missing"

    def all_of(prefix, count):
        return reduce(lambda a, b: a & b, [F.col(f"{prefix}{i}") for i in range(count)], F.lit(True))

    return _spread(
        scopes,
        by,
        F.when(~hit & F.lit(need.required), _issue("required_detection_missing")),
        F.when(hit & ~all_of("t", len(need.event_types)), _issue(code)),
        F.when(
            hit & ~all_of("s", len(need.statuses)),
            _issue(code, field="payload.evidence_link.verification_status"),
        ),
    )


def check_integrity(df: DataFrame, verdict: DataFrame, by: str = "journal_id") -> DataFrame:
    """Journals that are unverified, broken, or differ from the verified snapshot.

    `df` holds the journal, record_number and event_hash of the supplied events.
    """

    supplied = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("event_hash", "record_number").alias("end_hash")
    )
    joined = supplied.join(verdict, by, "left")
    ok = F.col("ok")
    same = (F.col("records_verified") == F.col("n")) & F.col("last_event_hash").eqNullSafe(
        F.col("end_hash")
    )
    field = "journal.integrity"
    return _spread(
        joined,
        [by],
        F.when(ok.isNull(), _issue("journal_integrity_unverified", field=field)),
        F.when(
            ok.isNotNull() & ~ok,
            _issue("journal_integrity_violation", F.col("event_id"), field=field),
        ),
        F.when(ok & ~same, _issue("journal_integrity_snapshot_mismatch", field=field)),
    )


class _Facts:
    """Conditions on the events of a scope; equal conditions are aggregated once."""

    def __init__(self):
        self.conditions: dict[str, Column] = {}

    def any(self, key: str, condition: Column) -> Column:
        """Whether some event of the scope meets `condition`, which `key` describes."""

        self.conditions.setdefault(key, _any(condition))
        return F.col(f"__f{list(self.conditions).index(key)}")

    def kind(self, event_type: str) -> Column:
        return self.any(f"type {event_type}", F.col("event_type") == event_type)

    def status(self, status: str) -> Column:
        return self.any(f"status {status}", _has_status(status))

    def aggregates(self) -> list[Column]:
        return [c.alias(f"__f{i}") for i, c in enumerate(self.conditions.values())]


def _named(contract, issue: Column) -> Column:
    return F.struct(F.lit(contract).alias("contract"), issue.alias("i"))


def _spread_named(df: DataFrame, by, issues) -> DataFrame:
    """One row per issue that is not null, with its contract."""

    found = F.filter(F.array(*issues), lambda n: n["i"].isNotNull())
    return df.select(*by, F.explode(found).alias("n")).select(*by, "n.contract", "n.i.*")


def _scope_issues(df: DataFrame, contracts, by, matches: DataFrame | None) -> DataFrame | None:
    """All that is decided by what a scope holds: one aggregate for all contracts."""

    facts, issues = _Facts(), []
    for contract in contracts:
        own = []
        for need in contract.events:
            there = facts.kind(need.event_type)
            own.append(F.when(~there, _issue("required_event_missing", event_type=need.event_type)))
            for path in need.fields:
                held = facts.any(
                    f"field {need.event_type} {path}", (F.col("event_type") == need.event_type) & _nonempty(path)
                )
                missing = _issue("required_field_missing", event_type=need.event_type, field=path)
                own.append(F.when(there & ~held, missing))
        if contract.required_status is not None:
            missing = _issue("verification_status_missing", field=STATUS_FIELD)
            own.append(F.when(~facts.status(contract.required_status), missing))
        for need in contract.links:
            missing = _issue("evidence_link_event_missing", event_type=need.event_type)
            own.append(F.when(~facts.kind(need.event_type), missing))
        for need in contract.latency:
            missing = _issue("latency_event_missing", event_type=need.end)
            own.append(F.when(~(facts.kind(need.start) & facts.kind(need.end)), missing))
        for need in contract.descriptors:
            missing = _issue("descriptor_event_missing", event_type=need.event_type)
            own.append(F.when(~facts.kind(need.event_type), missing))
        for need in contract.detections if matches is not None else ():
            hit = F.array_contains(F.coalesce("__hits", F.array().cast("array<string>")), need.rule_id)
            code = "detection_control_dependency_missing"
            kinds = [facts.kind(kind) for kind in need.event_types]
            statuses = [facts.status(status) for status in need.statuses]
            own.append(F.when(~hit & F.lit(need.required), _issue("required_detection_missing")))
            own.append(F.when(hit & ~reduce(and_, kinds, F.lit(True)), _issue(code)))
            own.append(F.when(hit & ~reduce(and_, statuses, F.lit(True)), _issue(code, field=STATUS_FIELD)))
        issues += [_named(contract.name, issue) for issue in own]
    if not issues:
        return None
    scopes = df.groupBy(*by).agg(*(facts.aggregates() or [F.count(F.lit(1)).alias("__n")]))
    if matches is not None:
        hits = matches.groupBy(*by).agg(F.collect_set("rule_id").alias("__hits"))
        scopes = scopes.join(hits, list(by), "left")
    return _spread_named(scopes, by, issues)


def _status_issues(df: DataFrame, contracts, by) -> DataFrame | None:
    allowed = [c for c in contracts if c.allowed_statuses]
    if not allowed:
        return None
    both = F.array("evidence_link.verification_status", "payload_status")
    found = df.select(*by, F.explode(both).alias("field")).filter("field IS NOT NULL").distinct()
    issues = [
        _named(
            c.name,
            F.when(
                ~F.col("field").isin(*c.allowed_statuses),
                _issue("verification_status_not_allowed", field=F.col("field")),
            ),
        )
        for c in allowed
    ]
    return _spread_named(found, by, issues)


def _link_rows(df: DataFrame, needs, by) -> DataFrame:
    """Events of the needed types with the types of the two events that their links name."""

    link = F.col("evidence_link")
    rows = df.filter(F.col("event_type").isin(*sorted({n.event_type for n in needs}))).select(
        *by,
        "event_id",
        "event_type",
        "evidence_link",
        link["subject_event_id"].alias("subject_id"),
        link["evidence_event_id"].alias("proof_id"),
    )
    # Types of the referenced events only; the distinct ids spread a popular target.
    ids = rows.select(*by, F.explode(F.array("subject_id", "proof_id")).alias("id"))
    ids = ids.filter("id IS NOT NULL").distinct()
    # An id that is recorded more than once counts as its last record.
    known = (
        ids.join(
            df.select(*by, F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "sequence"),
            [*by, "id"],
        )
        .groupBy(*by, "id")
        .agg(F.max_by("kind", F.struct("sequence", "kind")).alias("kind"))
    )
    subject = known.select(*by, F.col("id").alias("subject_id"), F.col("kind").alias("subject_kind"))
    proof = known.select(*by, F.col("id").alias("proof_id"), F.col("kind").alias("proof_kind"))
    return rows.join(subject, [*by, "subject_id"], "left").join(proof, [*by, "proof_id"], "left")


def _link_issues_of(need: LinkRequirement) -> list[Column]:
    """Faults of one row of `_link_rows`; the first kind of fault ends a row."""

    link = F.col("evidence_link")
    wanted = F.col("event_type") == need.event_type
    no_link = link.isNull()
    no_ids = ~no_link & (F.col("subject_id").isNull() | F.col("proof_id").isNull())
    dangling = ~no_link & ~no_ids & (F.col("subject_kind").isNull() | F.col("proof_kind").isNull())
    sound = ~no_link & ~no_ids & ~dangling

    def issue(code, field):
        return _issue(code, F.col("event_id"), F.col("event_type"), field)

    issues = [
        F.when(wanted & no_link, issue("evidence_link_missing", "payload.evidence_link")),
        F.when(wanted & no_ids, issue("evidence_link_field_missing", "payload.evidence_link")),
        F.when(wanted & dangling, issue("evidence_link_reference_missing", "payload.evidence_link")),
    ]
    values = [
        (need.subject_type, F.col("subject_kind"), "subjectEventType"),
        (need.evidence_type, F.col("proof_kind"), "evidenceEventType"),
        (need.relationship, link["relationship"], "relationship"),
        (need.status, link["verification_status"], "verificationStatus"),
        (need.observer, link["observer_identity"], "observerIdentity"),
    ]
    mismatch = "evidence_link_requirement_mismatch"
    for expected, actual, name in values:
        if expected is not None:
            other = wanted & sound & ~actual.eqNullSafe(F.lit(expected))
            issues.append(F.when(other, issue(mismatch, f"payload.evidence_link.{name}")))
    if need.corroboration_types:
        allowed = F.coalesce(link["corroboration_type"].isin(*need.corroboration_types), F.lit(False))
        issues.append(
            F.when(wanted & sound & ~allowed, issue(mismatch, "payload.evidence_link.corroboration_type"))
        )
    return issues


def validate(
    df: DataFrame, contracts, by, matches: DataFrame | None = None, integrity: DataFrame | None = None
) -> DataFrame:
    """All checks of all contracts for every scope; `integrity` rows come from check_integrity.

    What a scope holds is one aggregate, the links of all contracts are one pass, so
    are the descriptors and the statuses; only relationships and latencies, which
    join or order the events each in their own way, take a pass of their own.
    """

    by, contracts = list(by), list(contracts)
    found = [_scope_issues(df, contracts, by, matches), _status_issues(df, contracts, by)]
    links = [(c.name, n) for c in contracts for n in c.links]
    if links:
        issues = [_named(name, i) for name, n in links for i in _link_issues_of(n)]
        found.append(_spread_named(_link_rows(df, [n for _, n in links], by), by, issues))
    descriptors = [(c.name, n) for c in contracts for n in c.descriptors]
    if descriptors:
        kinds = sorted({n.event_type for _, n in descriptors})
        issues = [_named(name, i) for name, n in descriptors for i in _descriptor_issues(n)]
        found.append(_spread_named(df.filter(F.col("event_type").isin(*kinds)), by, issues))
    for contract in contracts:
        own = [check_relationship(df, n, by) for n in contract.relationships]
        own += [_latency_rows(df, n, by) for n in contract.latency]
        if contract.hash_chain_required and integrity is not None:
            own.append(integrity)
        found += [rows.withColumn("contract", F.lit(contract.name)) for rows in own]
    rows = reduce(lambda a, b: a.unionByName(b), [f for f in found if f is not None])
    return rows.select(*by, "contract", *SHAPE, F.lit("error").alias("severity"))
