"""Export profiles: the redacted event mapped to other record shapes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from witspark.functions.digest import sorted_json, uuid5_url
from witspark.functions.times import canonical_ts
from witspark.operators.redact import with_redacted
from witspark.schema import NAMESPACE


def redacted_events(df: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """Events with their redacted text in `event`, and the rows that cannot be redacted.

    The second table holds event ids and the error only, so that nothing is
    exported unredacted and no input row is lost without a trace.
    """

    return by_redaction(with_redacted(df, line, "__r"))


def by_redaction(safe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two tables of `redacted_events`, from rows with their redaction in `__r`."""

    good = safe.filter("__r.error IS NULL").withColumn("event", F.col("__r.json")).drop("__r")
    bad = safe.filter("__r.error IS NOT NULL").select(
        "event_id", F.col("__r.error").alias("error")
    )
    return good, bad


#: No text of an event can name a slot, as the slots' names are drawn anew by each process.
_DRAWN = uuid.uuid4().hex


def _slot(name: str) -> str:
    return f"@{name}-{_DRAWN}"


def _raw(text: Column, **slots: Column) -> Column:
    """JSON text whose slot values are replaced by given JSON texts."""

    for name, value in slots.items():
        text = F.replace(text, F.lit(f'"{_slot(name)}"'), value)
    return text


def _stix_id(kind: str) -> Column:
    name = F.concat(F.lit(f"{NAMESPACE}:{kind}:"), F.col("event_id"))
    return F.concat(F.lit(f"{kind}--"), uuid5_url(name))


def _native() -> Column:
    return F.col("event")


def _opentelemetry() -> Column:
    names = {
        f"{NAMESPACE}.event_id": F.col("event_id"),
        f"{NAMESPACE}.event_type": F.col("event_type"),
        f"{NAMESPACE}.spec_version": F.col("spec_version"),
        f"{NAMESPACE}.trace_id": F.col("trace_id"),
        f"{NAMESPACE}.run_id": F.col("run_id"),
        f"{NAMESPACE}.source.component": F.col("source_component"),
        f"{NAMESPACE}.payload_json": F.to_json(
            F.try_variant_get(F.try_parse_json("event"), "$.payload", "variant")
        ),
    }
    return sorted_json(**names)


def _ocsf() -> Column:
    text = sorted_json(
        metadata=F.struct(
            F.struct(F.lit(NAMESPACE).alias("name")).alias("product"),
            F.col("spec_version").alias("version"),
        ),
        class_name=F.lit("Agent Activity"),
        activity_name=F.col("event_type"),
        time=canonical_ts(F.col("occurred_at")),
        uid=F.col("event_id"),
        actor=F.struct("principal_id", "principal_type"),
        device=F.struct(F.col("source_instance_id").alias("uid")),
        raw_data=F.lit(_slot("event")),
    )
    return _raw(text, event=F.col("event"))


def _ecs() -> Column:
    text = sorted_json(
        **{
            "@timestamp": canonical_ts(F.col("occurred_at")),
            "event": F.struct(
                F.array(F.lit("process")).alias("category"),
                F.col("event_id").alias("id"),
                F.lit("event").alias("kind"),
                F.array("event_type").alias("type"),
            ),
            "trace": F.struct(F.col("trace_id").alias("id")),
            "agent": F.struct(F.col("source_component").alias("name")),
            NAMESPACE: F.lit(_slot("event")),
        }
    )
    return _raw(text, event=F.col("event"))


def _splunk() -> Column:
    text = sorted_json(
        time=canonical_ts(F.col("occurred_at")),
        source=F.lit(NAMESPACE),
        sourcetype=F.lit(f"{NAMESPACE}:evidence"),
        event=F.lit(_slot("event")),
    )
    return _raw(text, event=F.col("event"))


def _sigma() -> Column:
    return sorted_json(
        title=F.concat(F.lit(f"{NAMESPACE} "), "event_type"),
        logsource=F.struct(F.lit(NAMESPACE).alias("product")),
        detection=F.struct(
            F.lit("selection").alias("condition"),
            F.struct("event_id", "event_type").alias("selection"),
        ),
        fields=F.array(F.lit("event_id"), F.lit("event_type"), F.lit("correlation.trace_id")),
    )


def _stix_objects() -> Column:
    occurred, observed = canonical_ts(F.col("occurred_at")), canonical_ts(F.col("observed_at"))
    data = sorted_json(
        type=F.lit("observed-data"),
        id=_stix_id("observed-data"),
        created=occurred,
        modified=observed,
        first_observed=occurred,
        last_observed=observed,
        number_observed=F.lit(1),
        object_refs=F.array().cast("array<string>"),
        **{
            f"x_{NAMESPACE}_event_id": F.col("event_id"),
            f"x_{NAMESPACE}_event_type": F.col("event_type"),
            f"x_{NAMESPACE}_trace_id": F.col("trace_id"),
            f"x_{NAMESPACE}_run_id": F.col("run_id"),
            f"x_{NAMESPACE}_redacted_event": F.lit(_slot("event")),
        },
    )
    note = sorted_json(
        type=F.lit("note"),
        id=_stix_id("note"),
        created=observed,
        modified=observed,
        abstract=F.concat(F.lit(f"{NAMESPACE} "), "event_type"),
        content=F.lit(
            "This redacted event was exported for sharing."
            " The append-only journal remains the canonical evidence."
        ),
        object_refs=F.array(_stix_id("observed-data")),
    )
    return F.concat(F.lit("["), _raw(data, event=F.col("event")), F.lit(","), note, F.lit("]"))


def _stix() -> Column:
    text = sorted_json(
        type=F.lit("bundle"),
        id=_stix_id("bundle"),
        spec_version=F.lit("2.1"),
        objects=F.lit(_slot("objects")),
    )
    return _raw(text, objects=_stix_objects())


def _taxii() -> Column:
    return _raw(
        sorted_json(more=F.lit(False), objects=F.lit(_slot("objects"))), objects=_stix_objects()
    )


PROFILES = {
    "native": _native,
    "opentelemetry": _opentelemetry,
    "ocsf": _ocsf,
    "ecs": _ecs,
    "splunk_hec": _splunk,
    "sigma": _sigma,
    "stix": _stix,
    "taxii": _taxii,
}


def export(df: DataFrame, profile: str) -> DataFrame:
    """(event_id, record): redacted events, from `redacted_events`, in one profile."""

    if profile not in PROFILES:
        raise ValueError(f"unsupported export profile: {profile}")
    return df.select("event_id", PROFILES[profile]().alias("record"))
