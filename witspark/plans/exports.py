"""Export queries over the event lines of `events`."""

from pyspark.sql import functions as F

from witspark import schema as S
from witspark.operators import export as X
from witspark.plans.lineage import written_table
from witspark.plans.projection import SEEN
from witspark.plans.registry import query
from witspark.sources.tables import event_line, flat_events

N = S.NAMESPACE


def redacted(spark, sf_dir):
    lines = event_line(flat_events(spark, sf_dir)).drop("payload_v", "payload")
    return written_table(spark, "redacted", sf_dir, lambda: X.redacted_events(lines)[0])


def parts(spark, sf_dir, profile, **paths):
    rows = X.export(redacted(spark, sf_dir), profile)
    return rows.select(
        "event_id", *[F.get_json_object("record", path).alias(name) for name, path in paths.items()]
    )


@query(
    "exp_native",
    f"""WITH {{EV}} SELECT event_id, run_id AS run, event_type AS kind, {SEEN} AS occurred,
    tool_name AS tool, CAST(sequence AS VARCHAR) AS place FROM evc""",
)
def native(spark, sf_dir):
    return parts(
        spark,
        sf_dir,
        "native",
        run="$.correlation.run_id",
        kind="$.event_type",
        occurred="$.occurred_at",
        tool="$.payload.tool_identity.name",
        place="$.causality.sequence",
    )


@query(
    "exp_otel",
    f"""WITH {{EV}} SELECT event_id, event_id AS id, trace_id AS trace, run_id AS run, 'recorder' AS component,
    label AS label FROM ev""",
)
def otel(spark, sf_dir):
    rows = parts(
        spark,
        sf_dir,
        "opentelemetry",
        id=f"$['{N}.event_id']",
        trace=f"$['{N}.trace_id']",
        run=f"$['{N}.run_id']",
        component=f"$['{N}.source.component']",
        payload=f"$['{N}.payload_json']",
    )
    return rows.withColumn("label", F.get_json_object("payload", "$.label")).drop("payload")


@query(
    "exp_ocsf",
    f"""WITH {{EV}} SELECT event_id, event_type AS activity, {SEEN} AS at_time, principal_id AS actor,
    'recorder_' || user_id % 5 AS device, trace_id AS raw_trace, 'Agent Activity' AS class FROM ev""",
)
def ocsf(spark, sf_dir):
    return parts(
        spark,
        sf_dir,
        "ocsf",
        activity="$.activity_name",
        at_time="$.time",
        actor="$.actor.principal_id",
        device="$.device.uid",
        raw_trace="$.raw_data.correlation.trace_id",
        **{"class": "$.class_name"},
    )


@query(
    "exp_ecs",
    f"""WITH {{EV}} SELECT event_id, {SEEN} AS at_time, event_id AS id, event_type AS kind, trace_id AS trace,
    'recorder' AS agent, run_id AS raw_run FROM ev""",
)
def ecs(spark, sf_dir):
    return parts(
        spark,
        sf_dir,
        "ecs",
        at_time="$['@timestamp']",
        id="$.event.id",
        kind="$.event.type[0]",
        trace="$.trace.id",
        agent="$.agent.name",
        raw_run=f"$.{N}.correlation.run_id",
    )


@query(
    "exp_splunk",
    f"""WITH {{EV}} SELECT event_id, {SEEN} AS at_time, '{N}' AS source, '{N}:evidence' AS sourcetype,
    run_id AS raw_run FROM ev""",
)
def splunk(spark, sf_dir):
    return parts(
        spark,
        sf_dir,
        "splunk_hec",
        at_time="$.time",
        source="$.source",
        sourcetype="$.sourcetype",
        raw_run="$.event.correlation.run_id",
    )


@query(
    "exp_sigma",
    f"""WITH {{EV}} SELECT event_id, '{{"detection":{{"condition":"selection","selection":{{"event_id":"' || event_id
    || '","event_type":"' || event_type || '"}}}},"fields":["event_id","event_type","correlation.trace_id"],'
    || '"logsource":{{"product":"{N}"}},"title":"{N} ' || event_type || '"}}' AS record FROM ev""".replace("{{EV}}", "{EV}"),
)
def sigma(spark, sf_dir):
    return X.export(redacted(spark, sf_dir), "sigma")


_NS = "6ba7b8119dad11d180b400c04fd430c8"


def _uuid_sql(kind):
    digest = f"sha1(from_hex('{_NS}') || encode('{N}:{kind}:' || event_id))"
    variant = f"lower(printf('%02x', (CAST('0x' || substring({digest}, 17, 2) AS INTEGER) & 63) | 128))"
    return (
        f"'{kind}--' || substring({digest}, 1, 8) || '-' || substring({digest}, 9, 4) || '-5' ||"
        f" substring({digest}, 14, 3) || '-' || {variant} || substring({digest}, 19, 2) || '-' || substring({digest}, 21, 12)"
    )


@query(
    "exp_stix",
    f"""WITH {{EV}} SELECT event_id, {_uuid_sql('bundle')} AS bundle, {_uuid_sql('observed-data')} AS data,
    {_uuid_sql('note')} AS note, {_uuid_sql('observed-data')} AS refers, {SEEN} AS first_seen, trace_id AS trace,
    run_id AS raw_run FROM ev""",
)
def stix(spark, sf_dir):
    return parts(
        spark,
        sf_dir,
        "stix",
        bundle="$.id",
        data="$.objects[0].id",
        note="$.objects[1].id",
        refers="$.objects[1].object_refs[0]",
        first_seen="$.objects[0].first_observed",
        trace=f"$.objects[0].x_{N}_trace_id",
        raw_run=f"$.objects[0].x_{N}_redacted_event.correlation.run_id",
    )


@query(
    "exp_taxii",
    f"""WITH {{EV}} SELECT event_id, 'false' AS more, {_uuid_sql('observed-data')} AS data,
    'note' AS second, CAST(NULL AS VARCHAR) AS third FROM ev""",
)
def taxii(spark, sf_dir):
    return parts(
        spark,
        sf_dir,
        "taxii",
        more="$.more",
        data="$.objects[0].id",
        second="$.objects[1].type",
        third="$.objects[2].type",
    )
