"""Replay corpus queries: every run of `events` is a case."""

from pyspark.sql import functions as F

from witspark.operators import corpus as K, detect, integrity as I
from witspark.operators.rules import Rule, Stage
from witspark.plans.integrity import CHAIN, tampered
from witspark.plans.registry import query
from witspark.sources.tables import flat_events

SEED = 7


def cases(spark, sf_dir):
    df = flat_events(spark, sf_dir, payload=False)
    payload = F.to_json(
        F.struct(
            F.when(
                F.col("ack_status").isNotNull(),
                F.struct(F.col("ack_status").alias("status"), F.col("ack_note").alias("note")),
            ).alias("acknowledgement"),
            F.array(F.concat(F.lit("demo://workspace/"), "k"), F.lit("demo://workspace/./x")).alias("files"),
            F.concat(F.lit("http://receiver.local/"), "k").alias("url"),
            F.when(
                F.col("has_link"), F.struct(F.col("link_status").alias("verification_status"))
            ).alias("evidence_link"),
        )
    )
    return df.select(
        F.col("run_id").alias("case_id"),
        "event_id",
        "event_type",
        "run_id",
        "trace_id",
        "occurred_at",
        "observed_at",
        "sequence",
        F.col("sequence").alias("arrival"),
        payload.alias("payload"),
        (F.col("user_id") % 2 == 0).alias("expected_match"),
    )


def shown(df):
    return df.select("case_id", "event_id", "event_type", "sequence", "arrival")


_LAST = "z AS (SELECT evc.*, max(sequence) OVER (PARTITION BY run_id) + 1 AS size FROM evc)"


@query(
    "lab_mut_benign_distractor",
    f"""WITH {{EV}}, {_LAST} SELECT run_id AS case_id, event_id, event_type, sequence, sequence AS arrival FROM z UNION ALL
    SELECT run_id, event_id || '_benign_7', 'resource.observed', sequence, size FROM z WHERE sequence = size - 1""",
)
def benign(spark, sf_dir):
    return shown(K.benign_distractor(cases(spark, sf_dir), SEED))


@query(
    "lab_mut_duplicate_event",
    f"""WITH {{EV}}, {_LAST} SELECT run_id AS case_id, event_id, event_type, sequence, sequence AS arrival FROM z UNION ALL
    SELECT run_id, event_id || '_duplicate_7', event_type, sequence + 10007, size FROM z WHERE sequence = 7 % size""",
)
def duplicate(spark, sf_dir):
    return shown(K.duplicate_event(cases(spark, sf_dir), SEED))


@query(
    "lab_mut_reorder",
    f"""WITH {{EV}}, {_LAST} SELECT run_id AS case_id, event_id, event_type, sequence, size - 1 - sequence AS arrival FROM z""",
)
def reorder(spark, sf_dir):
    return shown(K.reorder(cases(spark, sf_dir)))


@query(
    "lab_mut_timestamp_skew",
    "WITH {EV} SELECT event_id, epoch_us(occurred_at) + 3000 AS observed_us, epoch_us(occurred_at) AS occurred_us FROM ev",
)
def skew(spark, sf_dir):
    df = K.timestamp_skew(cases(spark, sf_dir), SEED)
    return df.select(
        "event_id", F.unix_micros("observed_at").alias("observed_us"), F.unix_micros("occurred_at").alias("occurred_us")
    )


@query(
    "lab_mut_missing_optional",
    """WITH {EV}, f AS (SELECT run_id, min(sequence) AS s FROM evc WHERE ack_note IS NOT NULL GROUP BY run_id)
    SELECT event_id, CASE WHEN sequence = s THEN NULL ELSE ack_note END AS note, ack_status AS status
    FROM evc LEFT JOIN f ON f.run_id = evc.run_id""",
)
def missing_optional(spark, sf_dir):
    return K.missing_optional(cases(spark, sf_dir)).select(
        "event_id",
        F.get_json_object("payload", "$.acknowledgement.note").alias("note"),
        F.get_json_object("payload", "$.acknowledgement.status").alias("status"),
    )


@query(
    "lab_mut_path_url",
    """WITH {EV} SELECT event_id, 'demo://workspace/./' || k AS first, 'demo://workspace/./x' AS second,
    'http://receiver.local:80/' || k AS url FROM ev""",
)
def path_url(spark, sf_dir):
    return K.path_url(cases(spark, sf_dir)).select(
        "event_id",
        F.get_json_object("payload", "$.files[0]").alias("first"),
        F.get_json_object("payload", "$.files[1]").alias("second"),
        F.get_json_object("payload", "$.url").alias("url"),
    )


@query(
    "lab_mut_outcome_uncertainty",
    f"""WITH {{EV}}, f AS (SELECT run_id, min(sequence) AS s FROM evc WHERE event_type = 'side_effect.verified' GROUP BY run_id),
    j AS (SELECT evc.*, coalesce(sequence = s, false) AS hit FROM evc LEFT JOIN f ON f.run_id = evc.run_id)
    SELECT event_id, CASE WHEN hit THEN 'side_effect.unverified' ELSE event_type END AS event_type,
    CASE WHEN hit AND has_link THEN 'unverified' ELSE link_status END AS status,
    CASE WHEN hit AND has_link THEN '{K.UNCERTAIN_NOTE}' END AS note, false AS expected_match FROM j""",
)
def uncertainty(spark, sf_dir):
    return K.outcome_uncertainty(cases(spark, sf_dir)).select(
        "event_id",
        "event_type",
        F.get_json_object("payload", "$.evidence_link.verification_status").alias("status"),
        F.get_json_object("payload", "$.evidence_link.limitations[0]").alias("note"),
        "expected_match",
    )


@query(
    "lab_robustness_score",
    """WITH {EV}, a AS (SELECT run_id, any_value(user_id) % 2 = 0 AS expected,
    min(CASE WHEN event_type = 'agent.run.started' THEN sequence END) AS s,
    max(CASE WHEN event_type = 'side_effect.verified' THEN sequence END) AS v FROM evc GROUP BY run_id),
    m AS (SELECT *, coalesce(s < v, false) AS matched FROM a), b AS (
    SELECT 'plain' AS strategy, expected, matched FROM m UNION ALL
    SELECT 'reorder_unrelated', expected, matched FROM m)
    SELECT strategy, count(*) AS total_cases, count_if(matched = expected) AS passed_cases,
    count_if(matched <> expected) AS failed_cases, count_if(matched AND NOT expected) AS false_positives,
    count_if(expected AND NOT matched) AS false_negatives,
    count_if(matched = expected) / count(*) AS survival_rate,
    avg(CASE WHEN expected THEN CASE WHEN matched THEN 1.0 ELSE 0.0 END END) AS evidence_completeness,
    count_if(expected AND NOT matched) / count_if(expected) AS fragility FROM b GROUP BY strategy""",
)
def robustness(spark, sf_dir):
    """A two-stage rule over all cases, as they are and in reverse arrival."""
    plain = cases(spark, sf_dir).withColumn("strategy", F.lit("plain"))
    turned = K.mutate(cases(spark, sf_dir), "reorder_unrelated", SEED).withColumn(
        "strategy", F.lit("reorder_unrelated")
    )
    both = plain.unionByName(turned).withColumn("payload_v", F.try_parse_json("payload"))
    rule = Rule(
        "r", "r", (Stage("agent.run.started"), Stage("side_effect.verified")), group_by=("case",)
    )
    from witspark.functions.payload import Resolver

    found = detect.evaluate_rules(both, [rule], resolver=Resolver(columns={"case": "case_id"}))
    matches = found.select(
        F.col("group_key")[0].alias("case_id"), F.size("event_ids").alias("matched_events")
    )
    listed = both.select("case_id", "strategy", "expected_match").distinct()
    return K.robustness(listed, matches, 2, ["strategy"])


@query(
    "lab_replay_corpus",
    f"""{CHAIN} SELECT ver.journal_id, gs.i AS record_number FROM ver, generate_series(1::BIGINT, verified) gs(i) WHERE ok""",
)
def replay_corpus(spark, sf_dir):
    df = tampered(spark, sf_dir)
    return K.load_cases(df, I.verify_chain(df)).select("journal_id", "record_number")
