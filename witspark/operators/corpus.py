"""Replay corpus: mutations over all cases at once, and robustness scores.

A corpus row is an event with case_id, arrival (0, 1, 2, ... inside the case),
expected_match, and the flat event columns with the payload as JSON text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from witspark.functions.jsonwalk import canonical_text, strict_loads

# Spellings that mean the same place.
SPELLINGS = (
    ("demo://workspace/", "demo://workspace/./"),
    ("http://receiver.local/", "http://receiver.local:80/"),
)
UNCERTAIN_NOTE = "outcome made uncertain by a mutation"


def _edit(col: Column, change) -> Column:
    """Payload text with `change` applied to its value; null stays null."""

    @F.pandas_udf("string")
    def edit(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: None if t is None else canonical_text(change(strict_loads(t)))
        )

    return edit(col)


def _edit_where(df: DataFrame, chosen: Column, change) -> DataFrame:
    # Rows that are not chosen send a null through the Python step.
    edited = _edit(F.when(chosen, F.col("payload")), change)
    return df.withColumn("payload", F.when(chosen, edited).otherwise(F.col("payload")))


def _first_arrival(df: DataFrame, condition: Column) -> DataFrame:
    """Per case the arrival of the first event that meets the condition."""

    return df.groupBy("case_id").agg(
        F.min(F.when(condition, F.col("arrival"))).alias("__first")
    )


def benign_distractor(df: DataFrame, seed: int) -> DataFrame:
    """Append an unrelated copy of the last event of each case."""

    last = df.groupBy("case_id").agg(F.max_by(F.struct(*df.columns), "arrival").alias("e"))
    extra = last.select("e.*")
    extra = extra.withColumns(
        {
            "event_id": F.concat("event_id", F.lit(f"_benign_{seed}")),
            "event_type": F.lit("resource.observed"),
            "payload": F.lit(
                f'{{"resource":{{"path":"demo://benign-{seed}.txt","type":"file"}}}}'
            ),
            "arrival": F.col("arrival") + 1,
        }
    )
    return df.unionByName(extra)


def duplicate_event(df: DataFrame, seed: int) -> DataFrame:
    """Append a copy of the event at place seed mod n, with a new id and a later sequence."""

    sizes = df.groupBy("case_id").agg(F.count(F.lit(1)).alias("__n"))
    picked = df.join(sizes, "case_id").filter(F.col("arrival") == F.lit(seed) % F.col("__n"))
    extra = picked.withColumns(
        {
            "event_id": F.concat("event_id", F.lit(f"_duplicate_{seed}")),
            "sequence": F.col("sequence") + 10_000 + seed,
            "arrival": F.col("__n"),
        }
    ).drop("__n")
    return df.unionByName(extra.select(*df.columns))


def reorder(df: DataFrame) -> DataFrame:
    """Reverse the arrival order; event times stay."""

    sizes = df.groupBy("case_id").agg(F.count(F.lit(1)).alias("__n"))
    return (
        df.join(sizes, "case_id")
        .withColumn("arrival", F.col("__n") - 1 - F.col("arrival"))
        .select(*df.columns)
    )


def timestamp_skew(df: DataFrame, seed: int) -> DataFrame:
    """Observation times move by one to five milliseconds."""

    micros = F.unix_micros("observed_at") + (seed % 5 + 1) * 1000
    return df.withColumn("observed_at", F.timestamp_micros(micros))


def missing_optional(df: DataFrame) -> DataFrame:
    """Drop acknowledgement.note from the first event of each case that has one."""

    note = F.try_variant_get(F.try_parse_json("payload"), "$.acknowledgement.note", "variant")
    marked = df.withColumn("__has", note.isNotNull())
    first = _first_arrival(marked, F.col("__has"))
    joined = marked.join(first, "case_id", "left")
    chosen = F.coalesce(F.col("arrival") == F.col("__first"), F.lit(False)) & F.col("__has")

    def change(value):
        value["acknowledgement"].pop("note")
        return value

    return _edit_where(joined, chosen, change).select(*df.columns)


def _respell(value):
    if isinstance(value, str):
        for plain, other in SPELLINGS:
            if value.startswith(plain) and other not in value:
                return other + value[len(plain) :]
        return value
    if isinstance(value, list):
        return [_respell(v) for v in value]
    if isinstance(value, dict):
        return {k: _respell(v) for k, v in value.items()}
    return value


def path_url(df: DataFrame) -> DataFrame:
    """Equivalent spellings of paths and URLs on every string of the payload."""

    hit = F.lit(False)
    for plain, _other in SPELLINGS:
        hit = hit | F.contains("payload", F.lit(plain))
    return _edit_where(df, F.coalesce(hit, F.lit(False)), _respell).select(*df.columns)


def outcome_uncertainty(df: DataFrame) -> DataFrame:
    """The first verified event of each case becomes unverified; no match is expected then."""

    verified = F.col("event_type") == "side_effect.verified"
    joined = df.join(_first_arrival(df, verified), "case_id", "left")
    chosen = F.coalesce(F.col("arrival") == F.col("__first"), F.lit(False)) & verified
    joined = joined.withColumn("__chosen", chosen)

    def change(value):
        link = value.get("evidence_link")
        if isinstance(link, dict):
            link["verification_status"] = "unverified"
            link["limitations"] = [*(link.get("limitations") or []), UNCERTAIN_NOTE]
        return value

    edited = _edit_where(joined, F.col("__chosen"), change)
    return edited.withColumns(
        {
            "event_type": F.when(F.col("__chosen"), "side_effect.unverified").otherwise(
                F.col("event_type")
            ),
            "expected_match": F.lit(False),
        }
    ).select(*df.columns)


MUTATIONS = {
    "benign_distractor": benign_distractor,
    "duplicate_event": duplicate_event,
    "reorder_unrelated": lambda df, seed: reorder(df),
    "timestamp_skew": timestamp_skew,
    "missing_optional_field": lambda df, seed: missing_optional(df),
    "path_url_normalization": lambda df, seed: path_url(df),
    "outcome_uncertainty": lambda df, seed: outcome_uncertainty(df),
}


def mutate(df: DataFrame, strategy: str, seed: int) -> DataFrame:
    """All cases under one strategy, renamed `<case>/<strategy>-<seed>`."""

    changed = MUTATIONS[strategy](df, seed)
    return changed.withColumn(
        "case_id", F.concat("case_id", F.lit(f"/{strategy}-{seed}"))
    )


def load_cases(df: DataFrame, verdict: DataFrame) -> DataFrame:
    """Events of soundly verified journals only."""

    return df.join(verdict.filter("ok").select("journal_id"), "journal_id", "left_semi")


def robustness(cases: DataFrame, matches: DataFrame, stages: int, by=()) -> DataFrame:
    """Score of one rule: cases (case_id, expected_match), matches (case_id, matched_events)."""

    first = matches.groupBy("case_id").agg(F.min("matched_events").alias("matched_events"))
    joined = cases.join(first, "case_id", "left")
    matched = F.col("matched_events").isNotNull()
    expected = F.col("expected_match")
    whole = F.least(F.coalesce("matched_events", F.lit(0)) / F.lit(stages), F.lit(1.0))
    counts = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(matched == expected).alias("passed_cases"),
        F.count_if(matched & ~expected).alias("false_positives"),
        F.count_if(~matched & expected).alias("false_negatives"),
        F.count_if(expected).alias("positives"),
        F.coalesce(F.avg(F.when(expected, whole)), F.lit(1.0)).alias("evidence_completeness"),
    )
    total, positives = F.col("total_cases"), F.col("positives")
    return counts.select(
        *by,
        "total_cases",
        "passed_cases",
        (total - F.col("passed_cases")).alias("failed_cases"),
        "false_positives",
        "false_negatives",
        F.when(total > 0, F.col("passed_cases") / total).otherwise(0.0).alias("survival_rate"),
        "evidence_completeness",
        F.when(positives > 0, F.col("false_negatives") / positives).otherwise(0.0).alias("fragility"),
    )
