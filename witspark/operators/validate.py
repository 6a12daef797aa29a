"""Strict parsing and checks of event lines, causality, limits and compatibility."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from witspark import schema as S
from witspark.functions.jsonwalk import canonical_text, json_sizes, strict_loads
from witspark.functions.times import canonical_ts, to_utc


# Members in sorted order at every level, so that writing the parsed struct
# again gives the canonical text.
_CANONICAL = (
    "causality struct<parent_event_id string, root_event_id string, sequence bigint>,"
    " classification struct<sensitivity string, trust string>,"
    " correlation struct<run_id string, session_id string, span_id string, trace_id string>,"
    " event_id string, event_type string,"
    " integrity struct<canonicalization string, event_hash string, previous_event_hash string>,"
    " observed_at string, occurred_at string, payload variant,"
    " principal struct<credential_id string, model_id string, on_behalf_of string,"
    " principal_id string, principal_type string>,"
    " source struct<component string, instance_id string, version string>,"
    " spec_version string"
)
# Numbers whose spelling VARIANT may change: more than fifteen digits, very
# small, or with an exponent. All others print as they were written.
# One class comes first, so that most places of a text are passed at once.
_ODD_NUMBER = r'[:,\[](?<=":|,|\[)-?(?:[0-9.]{17,}|0\.0000|[0-9.]++[eE])'
_TEXTS = (
    "event_id",
    "event_type",
    "source.component",
    "source.instance_id",
    "source.version",
    "correlation.trace_id",
    "correlation.run_id",
    "causality.root_event_id",
    "principal.principal_id",
    "integrity.canonicalization",
)
_OPTIONAL_TEXTS = (
    "correlation.span_id",
    "correlation.session_id",
    "causality.parent_event_id",
    "principal.on_behalf_of",
    "principal.model_id",
    "principal.credential_id",
    "integrity.previous_event_hash",
    "integrity.event_hash",
)


def _envelope_error(text: str) -> str | None:
    """First fault of one event line; only lines that fail the column check get here."""

    import datetime as dt

    try:
        event = strict_loads(text)
    except (ValueError, RecursionError):
        return "invalid_json"
    if not isinstance(event, dict):
        return "invalid_json"
    if set(event) - set(S.ENVELOPE_FIELDS):
        return "unknown_field"
    for name in ("event_id", "event_type"):
        if not isinstance(event.get(name), str) or not event[name]:
            return f"missing:{name}"
    if event.get("spec_version", S.SPEC_VERSION) != S.SPEC_VERSION:
        return "unsupported_spec_version"
    for name in ("occurred_at", "observed_at"):
        try:
            if dt.datetime.fromisoformat(event.get(name).replace("Z", "+00:00")).tzinfo is None:
                return f"invalid_timestamp:{name}"
        except (AttributeError, ValueError):
            return f"invalid_timestamp:{name}"
    for part, required, optional in S.ENVELOPE_PARTS:
        inner = event.get(part, {} if part == "integrity" else None)
        if inner is None:
            return f"missing:{part}"
        if not isinstance(inner, dict):
            return f"not_an_object:{part}"
        if set(inner) - set(required + optional):
            return f"unknown_field:{part}"
        for member in required + optional:
            value = inner.get(member)
            if member == "sequence":
                if not isinstance(value, int) or isinstance(value, bool) or value < 0:
                    return "invalid_sequence"
            elif value is None and member in optional:
                continue
            elif not isinstance(value, str) or not value:
                return f"invalid:{part}.{member}"
    if not isinstance(event.get("payload", {}), dict):
        return "not_an_object:payload"
    for part, member, allowed in (
        ("principal", "principal_type", S.PRINCIPAL_TYPES),
        ("classification", "sensitivity", S.SENSITIVITIES),
        ("classification", "trust", S.TRUST_LEVELS),
    ):
        if event[part].get(member, "unknown") not in allowed:
            return f"invalid:{member}"
    causality = event["causality"]
    if causality.get("parent_event_id") is None:
        if event["event_type"] not in S.ROOT_EVENT_TYPES:
            return "parent_required"
        if causality["root_event_id"] != event["event_id"]:
            return "root_must_be_self"
    return None


def _line_faults(lines: Column) -> Column:
    """Struct (error, canonical) of the given lines; null lines cost nothing."""

    @F.pandas_udf("error string, canonical boolean")
    def faults(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            if text is None:
                rows.append((None, True))
                continue
            error = _envelope_error(text)
            same = error is None and canonical_text(strict_loads(text)) == text
            rows.append((error, same))
        return pd.DataFrame(rows, columns=["error", "canonical"])

    return faults(lines)


def causality_error(event_type, event_id, parent_id, root_id) -> Column:
    """Error text when a parentless event is no documented root, else null."""

    parentless = parent_id.isNull()
    return F.when(
        parentless & ~event_type.isin(*S.ROOT_EVENT_TYPES), "parent_required"
    ).when(parentless & ~root_id.eqNullSafe(event_id), "root_must_be_self")


def _all_members(line: Column) -> Column:
    """Whether canonical text names every envelope member."""

    names = ["spec_version", "payload"]
    for part, required, optional in S.ENVELOPE_PARTS:
        names += [part, *required, *optional]
    whole = F.lit(True)
    for name in names:
        whole = whole & F.contains(line, F.lit(f'"{name}":'))
    return whole


def parse_events(df: DataFrame, col: str = "line") -> DataFrame:
    """Add the flat envelope columns, `payload_v`, `error` and `canonical`.

    The field set is closed, required texts are non-empty, vocabularies are
    checked, timestamps need an offset, keys are unique and numbers finite. A
    line that the parsed struct writes back unchanged has exactly the known
    fields in canonical form; it only needs its values checked, in columns. The
    other lines are named their first fault by a small Python step, which sees
    nulls for all sound lines.
    """

    df = df.withColumn("__s", F.from_json(col, _CANONICAL))
    s, line = F.col("__s"), F.col(col)

    def at(path):
        return F.col(f"__s.{path}")

    occurred, observed = to_utc(at("occurred_at")), to_utc(at("observed_at"))
    sound = F.to_json(s, {"ignoreNullFields": "false"}) == line
    sound = sound & ~line.rlike(_ODD_NUMBER) & F.schema_of_variant(at("payload")).like("OBJECT%")
    for path in _TEXTS:
        sound = sound & (at(path) != "")
    for path in _OPTIONAL_TEXTS:
        sound = sound & (at(path).isNull() | (at(path) != ""))
    sound = sound & (at("causality.sequence") >= 0) & (at("spec_version") == S.SPEC_VERSION)
    sound = sound & at("principal.principal_type").isin(*S.PRINCIPAL_TYPES)
    sound = sound & at("classification.sensitivity").isin(*S.SENSITIVITIES)
    sound = sound & at("classification.trust").isin(*S.TRUST_LEVELS)
    sound = sound & (canonical_ts(occurred) == at("occurred_at"))
    sound = sound & (canonical_ts(observed) == at("observed_at"))
    causal = causality_error(
        at("event_type"), at("event_id"), at("causality.parent_event_id"), at("causality.root_event_id")
    )
    df = df.withColumn("__sound", F.coalesce(sound & causal.isNull(), F.lit(False)))
    df = df.withColumn("__f", _line_faults(F.when(~F.col("__sound"), line)))
    broken = F.coalesce(F.col("__f.error") == "invalid_json", F.lit(False))
    columns = {
        "event_id": at("event_id"),
        "event_type": at("event_type"),
        "spec_version": F.coalesce(at("spec_version"), F.lit(S.SPEC_VERSION)),
        "occurred_at": occurred,
        "observed_at": observed,
        "source_component": at("source.component"),
        "source_instance_id": at("source.instance_id"),
        "source_version": at("source.version"),
        "trace_id": at("correlation.trace_id"),
        "run_id": at("correlation.run_id"),
        "span_id": at("correlation.span_id"),
        "session_id": at("correlation.session_id"),
        "root_event_id": at("causality.root_event_id"),
        "parent_event_id": at("causality.parent_event_id"),
        "sequence": at("causality.sequence"),
        "principal_id": at("principal.principal_id"),
        "principal_type": at("principal.principal_type"),
        "sensitivity": F.coalesce(at("classification.sensitivity"), F.lit("unknown")),
        "trust": F.coalesce(at("classification.trust"), F.lit("unknown")),
        "canonicalization": F.coalesce(
            at("integrity.canonicalization"), F.lit(S.CANONICALIZATION)
        ),
        "previous_event_hash": at("integrity.previous_event_hash"),
        "event_hash": at("integrity.event_hash"),
        "payload_v": at("payload"),
    }
    added = {"error", "canonical", "__s", "__sound", "__f", *columns}
    # Canonical also means complete: optional members are written as nulls.
    return df.select(
        *[c for c in df.columns if c not in added],
        *[F.when(~broken, c).alias(n) for n, c in columns.items()],
        F.col("__f.error").alias("error"),
        (
            F.col("__sound")
            | (
                F.col("__f.canonical")
                & _all_members(line)
                & (canonical_ts(occurred) == at("occurred_at"))
                & (canonical_ts(observed) == at("observed_at"))
            )
        ).alias("canonical"),
    )


def check_causality(df: DataFrame) -> DataFrame:
    """Add `violation`: null, `parent_required` or `root_must_be_self`."""

    return df.withColumn(
        "violation",
        causality_error(
            F.col("event_type"),
            F.col("event_id"),
            F.col("parent_event_id"),
            F.col("root_event_id"),
        ),
    )


def json_limits(df: DataFrame, ids: list[str], payload: str = "payload") -> DataFrame:
    """Depth, largest object and longest array per payload, and whether all are in bounds."""

    sizes = json_sizes(df, ids, payload).groupBy(*ids).agg(
        *[F.max(name).alias(name) for name in ("max_depth", "max_members", "max_array")],
        F.every("parsed").alias("parsed"),
    )
    return sizes.select(
        *ids,
        "max_depth",
        "max_members",
        "max_array",
        (
            F.col("parsed")
            & (F.col("max_depth") <= S.MAX_DEPTH)
            & (F.col("max_members") <= S.MAX_MEMBERS)
            & (F.col("max_array") <= S.MAX_ITEMS)
        ).alias("ok"),
    )


def assess_compat(df: DataFrame) -> DataFrame:
    """Add `status`, `can_read` and `can_interpret` by spec version and event type."""

    readable = F.col("spec_version").isin(*S.READABLE_SPEC_VERSIONS)
    known = F.col("event_type").isin(*S.EVENT_TYPES)
    return df.select(
        "*",
        F.when(~readable, "unsupported")
        .when(known, "supported_known")
        .otherwise("supported_unknown")
        .alias("status"),
        readable.alias("can_read"),
        (readable & known).alias("can_interpret"),
    )


def collect_records(*sources: DataFrame) -> DataFrame:
    """Union of several adapters' records; `source_ordinal` keeps the adapter order."""

    numbered = [df.withColumn("source_ordinal", F.lit(i)) for i, df in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
