"""Text patterns, bounded capture and their fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from witspark.functions.digest import sha256_label
from witspark.functions.jsonwalk import CAPTURE_MARKER

REDACTED_MARKER = "witspark.redacted.v1"
DIGEST_SCOPE = "witspark.capture.v1/redaction-boundary"
LOG_CAPTURE_MARKER = "witspark.log.capture.v1"
LOG_FAILURE_MARKER = "witspark.log.redaction_failed.v1"
REDACTED_VALUE = "[REDACTED:sensitive]"
LOG_CAPTURE_VALUE = "[OMITTED:bounded-capture]"
LOG_DIGEST_UNAVAILABLE = "[UNAVAILABLE:missing-or-unsupported-digest-scope]"

MAX_TEXT = 4096
MAX_BYTES = 4096
MAX_LOG_TEXT = 512
MAX_CAPTURES = 128
MAX_CAPTURED_BYTES = 65536

# Field names whose value is always hidden.
SENSITIVE_NAMES = frozenset(
    (
        "access_token",
        "api_key",
        "apikey",
        "auth_token",
        "authorization",
        "aws_access_key_id",
        "aws_secret_access_key",
        "aws_session_token",
        "bearer_token",
        "client_secret",
        "client_secret_value",
        "cloud_session_token",
        "connection_string",
        "cookie",
        "database_dsn",
        "database_url",
        "db_url",
        "dsn",
        "id_token",
        "oauth_token",
        "password",
        "pre_signed_url",
        "presigned_url",
        "private_key_pem",
        "private_key",
        "proxy_authorization",
        "refresh_token",
        "secret",
        "security_token",
        "set_cookie",
        "signed_url",
        "signing_secret",
        "session_cookie",
        "session_token",
        "ssh_private_key",
        "token",
        "webhook_secret",
        "webhook_signature",
        "webhook_token",
        "x_api_key",
    )
)

# Paths whose text is never cut, though patterns still apply.
CAPTURE_EXEMPT = frozenset(
    (
        "spec_version",
        "event_id",
        "event_type",
        "occurred_at",
        "observed_at",
        "source.component",
        "source.instance_id",
        "source.version",
        "correlation.trace_id",
        "correlation.run_id",
        "correlation.span_id",
        "correlation.session_id",
        "causality.root_event_id",
        "causality.parent_event_id",
        "principal.principal_id",
        "principal.principal_type",
        "principal.on_behalf_of",
        "principal.model_id",
        "principal.credential_id",
        "classification.sensitivity",
        "classification.trust",
        "integrity.canonicalization",
        "integrity.previous_event_hash",
        "integrity.event_hash",
        "payload.evidence_link.subject_event_id",
        "payload.evidence_link.relationship",
        "payload.evidence_link.evidence_event_id",
        "payload.evidence_link.corroboration_type",
        "payload.evidence_link.observer_identity",
        "payload.evidence_link.verification_status",
        "payload.subject_event_id",
        "payload.evidence_event_id",
        "payload.verification_status",
    )
)

# Fixed values: (name, pattern, replacement), applied in this order.
PATTERNS = (
    (
        "private_key",
        r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----",
        r"[REDACTED:private_key]",
    ),
    (
        "bearer_token",
        r"\bBearer\s+[A-Za-z0-9._~+/=-]{8,}\b",
        r"Bearer [REDACTED:bearer_token]",
    ),
    (
        "database_url",
        r"(?i)\b(?:postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|redis|rediss|amqp|amqps)"
        r"://[^\s\"'<>]+",
        r"[REDACTED:database_url]",
    ),
    (
        "signed_url_parameter",
        r"(?i)\b(x-amz-signature|x-amz-credential|x-amz-security-token|signature|sig|"
        r"access_token|refresh_token|client_secret|token)=([^&\s\"'<>]{8,})",
        r"\1=[REDACTED:secret]",
    ),
    (
        "key_value_secret",
        r"(?i)(?<![A-Za-z0-9])(api[_-]?key|access[_-]?token|refresh[_-]?token|id[_-]?token|"
        r"client[_-]?secret|webhook[_-]?(?:secret|token|signature)|signing[_-]?secret|"
        r"session[_-]?token|security[_-]?token|aws[_-]?secret[_-]?access[_-]?key|"
        r"aws[_-]?session[_-]?token|private[_-]?key|token|password|secret)(?![A-Za-z0-9])"
        r"\s*[:=]\s*['\"]?[A-Za-z0-9._~+/=-]{8,}['\"]?",
        r"\1=[REDACTED:secret]",
    ),
)

# What must never appear in an artifact. The first pattern is this
# library's own: it takes canary texts of any three letters.
LEAK_PATTERNS = (
    ("synthetic_canary", r"[A-Z]{3}_CANARY_[A-Za-z0-9_-]+"),
    ("authorization_header", r"(?i)Authorization\s*:\s*Bearer\s+\S+"),
    ("bearer_token", r"Bearer\s+[A-Za-z0-9._~+/=-]{16,}"),
    ("github_classic_token", r"ghp_[A-Za-z0-9_]{20,}"),
    ("github_fine_grained_token", r"github_pat_[A-Za-z0-9_]{20,}"),
    ("openai_key", r"sk-[A-Za-z0-9_-]{20,}"),
)


def _java(pattern: str) -> str:
    # Word and space classes follow Unicode, as they do for text in Python.
    return "(?U)" + pattern


def _may_hold(name: str, text: Column) -> Column:
    """Cheap test that is true for every text the pattern can match."""

    if name == "private_key":
        return F.contains(text, F.lit("PRIVATE KEY-----"))
    if name == "bearer_token":
        return F.contains(text, F.lit("Bearer"))
    if name == "database_url":
        return F.contains(text, F.lit("://"))
    if name == "signed_url_parameter":
        return F.contains(text, F.lit("="))
    # Long s and dotless i equal s and i when case is ignored.
    low = F.lower(text)
    found = F.contains(text, F.lit("\u017f")) | F.contains(text, F.lit("\u0131"))
    for word in ("key", "token", "secret", "password", "signature"):
        found = found | F.contains(low, F.lit(word))
    return found


def replace_pattern(col: Column, name: str, pattern: str, replacement: str) -> Column:
    """One replacement; texts that cannot match skip the pattern."""

    shown = replacement.replace("\\1", "$1")

    def step(text):
        return F.when(
            _may_hold(name, text), F.regexp_replace(text, _java(pattern), shown)
        ).otherwise(text)

    # The lambda names the text once, however often the step looks at it.
    return F.get(F.transform(F.array(col), step), F.lit(0))


def count_pattern(col: Column, name: str, pattern: str) -> Column:
    """Number of replacements the pattern makes."""

    count = F.regexp_count(col, F.lit(_java(pattern))).cast("bigint")
    return F.when(_may_hold(name, col), count).otherwise(F.lit(0).cast("bigint"))


def redact_text(col: Column) -> Column:
    """Text with every pattern replaced, in order."""

    for name, pattern, replacement in PATTERNS:
        col = replace_pattern(col, name, pattern, replacement)
    return col


def _scoped_digest(kind: str, content: Column) -> Column:
    head = f"{DIGEST_SCOPE}\0{kind}\0".encode()
    return sha256_label(F.concat(F.lit(bytearray(head)), content))


def capture_text(col: Column, limit: int = MAX_TEXT) -> Column:
    """Capture struct of a text longer than `limit` code points, else null."""

    return F.when(
        F.length(col) > limit,
        F.struct(
            F.lit(CAPTURE_MARKER).alias("marker"),
            F.lit("text").alias("encoding"),
            F.substring(col, 1, limit).alias("value"),
            F.length(col).cast("bigint").alias("original_length"),
            F.lit(limit).cast("bigint").alias("captured_length"),
            F.lit(True).alias("truncated"),
            _scoped_digest("text", F.encode(col, "UTF-8")).alias("digest"),
            F.lit(DIGEST_SCOPE).alias("digest_scope"),
        ),
    )


def capture_bytes(col: Column, limit: int = MAX_BYTES) -> Column:
    """Capture struct of a binary value; binary is always captured."""

    size = F.octet_length(col).cast("bigint")
    return F.struct(
        F.lit(CAPTURE_MARKER).alias("marker"),
        F.lit("base64").alias("encoding"),
        F.replace(F.base64(F.substring(col, 1, limit)), F.lit("\r\n"), F.lit("")).alias("value"),
        size.alias("original_length"),
        F.least(size, F.lit(limit).cast("bigint")).alias("captured_length"),
        (size > limit).alias("truncated"),
        _scoped_digest("base64", col).alias("digest"),
        F.lit(DIGEST_SCOPE).alias("digest_scope"),
    )


@dataclass(frozen=True)
class Policy:
    """Redaction policy for free-form JSON; paths are lower case and dot-separated."""

    sensitive_paths: frozenset = field(default_factory=frozenset)
    sensitive_names: frozenset = SENSITIVE_NAMES
    exempt_paths: frozenset = CAPTURE_EXEMPT
    max_text: int = MAX_TEXT
    max_captures: int = MAX_CAPTURES
    max_captured_bytes: int = MAX_CAPTURED_BYTES
    max_depth: int = 64
    max_members: int = 4096
    max_items: int = 4096
