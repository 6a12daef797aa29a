"""Event envelope schema and the fixed vocabularies of the data model."""

from pyspark.sql import types as T

NAMESPACE = "witspark"
SPEC_VERSION = f"{NAMESPACE}/event-v1"
CANONICALIZATION = f"{NAMESPACE}/json-sorted-v0"
READABLE_SPEC_VERSIONS = (SPEC_VERSION,)

MAX_DEPTH = 64
MAX_MEMBERS = 4096
MAX_ITEMS = 4096

# The documented event types.
EVENT_TYPES = (
    "agent.intent.recorded",
    "agent.run.started",
    "agent.run.completed",
    "agent.run.failed",
    "agent.tool.discovered",
    "agent.tool.schema_changed",
    "agent.tool.call.requested",
    "agent.tool.call.started",
    "agent.tool.call.completed",
    "agent.tool.call.failed",
    "agent.tool.call.denied",
    "policy.evaluation.started",
    "policy.decision",
    "approval.requested",
    "approval.resolved",
    "tool.execution.requested",
    "tool.execution.authorized",
    "tool.execution.dispatched",
    "tool.execution.acknowledged",
    "tool.execution.not_dispatched",
    "side_effect.observed",
    "side_effect.verified",
    "side_effect.unverified",
    "side_effect.timed_out",
    "side_effect.conflict_detected",
    "resource.observed",
    "action.normalized",
    "lineage.alert.created",
    "recorder.degraded",
    "projection.rebuilt",
    "integrity.verification.failed",
)
# The event types that may start a run without a parent.
ROOT_EVENT_TYPES = ("agent.intent.recorded", "agent.run.started", "recorder.degraded")
# The other closed vocabularies.
PRINCIPAL_TYPES = ("human", "service", "agent", "model", "workload", "credential", "unknown")
SENSITIVITIES = ("public", "internal", "confidential", "restricted", "secret", "unknown")
TRUST_LEVELS = ("trusted", "untrusted", "local", "external", "unknown")
STATUSES = ("unknown", "unverified", "timed_out", "conflicting", "observed", "verified")
UNCERTAIN_STATUSES = ("unknown", "unverified", "timed_out", "conflicting")
RELATIONSHIPS = ("corroborates", "contradicts", "observes", "limits")
CORROBORATION_TYPES = (
    "independent_observer",
    "post_action_readback",
    "fixture_oracle",
    "self_reported",
    "unknown",
)


def _strings(*names):
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


SOURCE = _strings("component", "instance_id", "version")
CORRELATION = _strings("trace_id", "run_id", "span_id", "session_id")
CAUSALITY = T.StructType(
    [
        T.StructField("root_event_id", T.StringType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("parent_event_id", T.StringType()),
    ]
)
PRINCIPAL = _strings(
    "principal_id", "principal_type", "on_behalf_of", "model_id", "credential_id"
)
CLASSIFICATION = _strings("sensitivity", "trust")
INTEGRITY = _strings("canonicalization", "previous_event_hash", "event_hash")

LINK = T.StructType(
    [
        T.StructField("subject_event_id", T.StringType()),
        T.StructField("relationship", T.StringType()),
        T.StructField("evidence_event_id", T.StringType()),
        T.StructField("corroboration_type", T.StringType()),
        T.StructField("observer_identity", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("verification_status", T.StringType()),
        T.StructField("limitations", T.ArrayType(T.StringType())),
    ]
)

# Nested parts of the envelope: (field, required members, optional members).
ENVELOPE_PARTS = (
    ("source", ("component", "instance_id", "version"), ()),
    ("correlation", ("trace_id", "run_id"), ("span_id", "session_id")),
    ("causality", ("root_event_id", "sequence"), ("parent_event_id",)),
    (
        "principal",
        ("principal_id", "principal_type"),
        ("on_behalf_of", "model_id", "credential_id"),
    ),
    ("classification", (), ("sensitivity", "trust")),
    ("integrity", (), ("canonicalization", "previous_event_hash", "event_hash")),
)
ENVELOPE_FIELDS = (
    "spec_version",
    "event_id",
    "event_type",
    "occurred_at",
    "observed_at",
    "source",
    "correlation",
    "causality",
    "principal",
    "classification",
    "payload",
    "integrity",
)

# Dotted envelope path -> column of the flat event table.
ENVELOPE_COLUMNS = {
    "spec_version": "spec_version",
    "event_id": "event_id",
    "event_type": "event_type",
    "source.component": "source_component",
    "source.instance_id": "source_instance_id",
    "source.version": "source_version",
    "correlation.trace_id": "trace_id",
    "correlation.run_id": "run_id",
    "correlation.span_id": "span_id",
    "correlation.session_id": "session_id",
    "causality.root_event_id": "root_event_id",
    "causality.parent_event_id": "parent_event_id",
    "principal.principal_id": "principal_id",
    "principal.principal_type": "principal_type",
    "classification.sensitivity": "sensitivity",
    "classification.trust": "trust",
}

# Envelope paths that a valid event always fills; nothing needs to look behind them.
ALWAYS_PRESENT = frozenset(ENVELOPE_COLUMNS) - {
    "correlation.span_id",
    "correlation.session_id",
    "causality.parent_event_id",
}

PROJECTED_COLUMNS = (
    "event_id",
    "spec_version",
    "event_type",
    "occurred_at",
    "observed_at",
    "trace_id",
    "run_id",
    "span_id",
    "session_id",
    "root_event_id",
    "parent_event_id",
    "sequence",
    "event_hash",
    "previous_event_hash",
    "verification_status",
    "evidence_subject_event_id",
    "evidence_event_id",
    "journal_record_number",
    "event_json",
)
