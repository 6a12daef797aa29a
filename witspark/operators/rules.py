"""Detection rules as plain driver-side objects, and the shipped rule packs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from witspark.functions.predicates import check_predicate


@dataclass(frozen=True)
class Stage:
    event_type: str
    where: dict = field(default_factory=dict)
    name: str | None = None


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    stages: tuple[Stage, ...]
    severity: str = "medium"
    group_by: tuple[str, ...] = ("correlation.run_id",)
    ordered: bool = True
    within_seconds: float | None = None
    deduplicate: bool = True
    suppression_seconds: float | None = None
    suppression_key: tuple[str, ...] = ()
    version: str = "1"
    tags: tuple[str, ...] = ()
    rationale: str | None = None
    references: tuple[str, ...] = ()
    required_evidence_quality: tuple[str, ...] = ()


_UNITS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}


def duration_seconds(value) -> float | None:
    """`90`, `"90s"`, `"2m"`, `"1.5h"` or `"250ms"` as seconds."""

    if value is None:
        return None
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    found = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)(ms|s|m|h)?", str(value).strip())
    if found is None or not isinstance(value, str):
        raise ValueError(f"invalid duration: {value!r}")
    return float(found[1]) * _UNITS[found[2] or "s"]


def _texts(value) -> tuple[str, ...]:
    """A list of texts; a single one counts as a list of one."""

    if value is None:
        return ()
    values = (value,) if isinstance(value, str) else tuple(value)
    if not all(isinstance(v, str) for v in values):
        raise ValueError("a list of texts is needed")
    return values


def rule_from_dict(data: dict) -> Rule:
    """Rule from a parsed JSON or YAML object; unknown predicates are an error."""

    stages = []
    for item in data.get("stages", ()):
        where = item.get("where") or {}
        for expected in where.values():
            check_predicate(expected)
        stages.append(Stage(item["event_type"], where, item.get("name")))
    return Rule(
        rule_id=data.get("rule_id") or data["name"],
        name=data["name"],
        stages=tuple(stages),
        severity=data.get("severity", "medium"),
        group_by=tuple(data.get("group_by", ("correlation.run_id",))),
        ordered=data.get("ordered", True),
        within_seconds=duration_seconds(data.get("within_seconds", data.get("within"))),
        deduplicate=data.get("deduplicate", True),
        suppression_seconds=duration_seconds(
            data.get("suppression_seconds", data.get("suppression"))
        ),
        suppression_key=tuple(data.get("suppression_key", ())),
        version=str(data.get("version", "1")),
        tags=tuple(data.get("tags", ())),
        rationale=data.get("rationale"),
        references=tuple(data.get("references", ())),
        required_evidence_quality=_texts(data.get("required_evidence_quality")),
    )


def _verified(status="verified"):
    return {"evidence_link.verification_status": status}


def _acknowledged(tool):
    return Stage("tool.execution.acknowledged", {"tool_identity.name": tool})


_NOT_FORWARDED = {"not_dispatched.downstream_forwarded": False}

# The starter rules.
STARTER = (
    Rule(
        "starter.restricted_read_then_verified_send",
        "restricted read followed by a verified send",
        (
            Stage("action.normalized", {"action.resources.0.attributes.sensitivity": "restricted"}),
            Stage("side_effect.verified", _verified()),
        ),
        severity="high",
    ),
    Rule(
        "starter.descriptor_drift_then_action",
        "descriptor drift before an action",
        (Stage("agent.tool.schema_changed"), Stage("action.normalized")),
    ),
    Rule(
        "starter.acknowledged_not_observed",
        "acknowledged send without observation",
        (
            Stage(
                "tool.execution.acknowledged",
                {
                    "tool_identity.name": "safe_http.send",
                    "acknowledgement.status": {"in": ["success", "succeeded"]},
                },
            ),
            Stage("side_effect.unverified", _verified({"in": ["unverified", "timed_out"]})),
        ),
    ),
    Rule(
        "starter.conflicting_evidence",
        "conflicting observer evidence",
        (Stage("side_effect.conflict_detected"),),
        severity="high",
    ),
    Rule(
        "starter.policy_failure_before_dispatch",
        "policy failure before dispatch",
        (
            Stage("policy.decision", {"outcome": {"in": ["deny", "error"]}}),
            Stage("tool.execution.not_dispatched", _NOT_FORWARDED),
        ),
        severity="high",
    ),
)

# The validation rules, of two to four stages.
VALIDATION = (
    Rule(
        "validation.verified_read",
        "acknowledged read with verified effect",
        (_acknowledged("safe_files.read"), Stage("side_effect.verified", _verified())),
    ),
    Rule(
        "validation.acknowledged_then_timeout",
        "acknowledged send that timed out",
        (
            _acknowledged("safe_http.send"),
            Stage("side_effect.timed_out", _verified("timed_out")),
        ),
    ),
    Rule(
        "validation.denied_not_dispatched",
        "denied and not dispatched",
        (
            Stage("policy.decision", {"outcome": "deny"}),
            Stage("tool.execution.not_dispatched", _NOT_FORWARDED),
        ),
    ),
    Rule(
        "validation.drift_then_conflict",
        "descriptor drift with conflicting evidence",
        (
            Stage("agent.tool.schema_changed"),
            Stage("side_effect.conflict_detected", _verified("conflicting")),
        ),
    ),
    Rule(
        "validation.read_then_send_unverified",
        "verified read, then unverified send",
        (
            _acknowledged("safe_files.read"),
            Stage("side_effect.verified", _verified()),
            _acknowledged("safe_http.send"),
            Stage("side_effect.unverified", _verified("unverified")),
        ),
    ),
    Rule(
        "validation.denied_then_alternative",
        "denied, then an allowed alternative",
        (
            Stage("policy.decision", {"outcome": "deny"}),
            Stage("tool.execution.not_dispatched", _NOT_FORWARDED),
            _acknowledged("safe_http.send"),
            Stage("side_effect.unverified", _verified("unverified")),
        ),
    ),
    Rule(
        "validation.service_denied_then_allowed",
        "service authentication denied, then allowed",
        (
            Stage("policy.decision", {"rule_id": "service_auth_required", "outcome": "deny"}),
            Stage("tool.execution.not_dispatched", {"not_dispatched.reason": "service_auth_denied"}),
            _acknowledged("service_api.read"),
            Stage("side_effect.verified", _verified()),
        ),
    ),
)
