"""Run scores and reports over tables of events, scorecards and scores."""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from witspark.functions.digest import sha256_label, sorted_json
from witspark.functions.jsonwalk import CAPTURE_MARKER, json_nodes, path_step, strict_loads, walk_json
from witspark.operators.ordered import in_order

LIFECYCLE = (
    "agent.run.started",
    "tool.execution.requested",
    "tool.execution.acknowledged",
    "side_effect.verified",
    "agent.run.completed",
)


def lifecycle_score(events: DataFrame, expect: DataFrame, run: str = "run_id") -> DataFrame:
    """What each run lacks or must not show: (run, problem, value).

    `expect` lists (run, kind, value) with kind event_type, status or forbidden.
    """

    seen = (
        events.select(
            run,
            F.explode(
                F.array(
                    F.struct(F.lit("event_type").alias("what"), F.col("event_type").alias("value")),
                    F.struct(F.lit("status").alias("what"), F.col("verification_status").alias("value")),
                )
            ).alias("s"),
        )
        .select(run, "s.*")
        .filter("value IS NOT NULL")
        .distinct()
    )
    wanted = expect.filter("kind <> 'forbidden'").withColumnRenamed("kind", "what")
    missing = wanted.join(seen, [run, "what", "value"], "left_anti").select(
        run, F.concat(F.lit("missing_"), "what").alias("problem"), "value"
    )
    barred = expect.filter("kind = 'forbidden'").select(run, F.lit("status").alias("what"), "value")
    present = barred.join(seen, [run, "what", "value"], "left_semi").select(
        run, F.lit("forbidden_status").alias("problem"), "value"
    )
    return missing.unionByName(present)


def detection_score(expected: DataFrame, matches: DataFrame, run: str = "run_id") -> DataFrame:
    """Expected (run, rule_id) pairs without a match."""

    return expected.join(matches.select(run, "rule_id").distinct(), [run, "rule_id"], "left_anti")


def capability_score(scenarios: DataFrame, covers: DataFrame) -> DataFrame:
    """Whether each scenario covers at least one capability."""

    counts = covers.groupBy("scenario_id").agg(
        F.count_distinct("capability").alias("capabilities")
    )
    joined = scenarios.join(counts, "scenario_id", "left")
    number = F.coalesce("capabilities", F.lit(0))
    return joined.select("scenario_id", number.alias("capabilities"), (number > 0).alias("ok"))


def replayability(runs: DataFrame, artifacts: DataFrame, required, run: str = "run_id") -> DataFrame:
    """Missing (run, artifact) pairs of the required artifact names."""

    wanted = runs.select(run, F.explode(F.array(*[F.lit(r) for r in required])).alias("artifact"))
    return wanted.join(artifacts.select(run, "artifact").distinct(), [run, "artifact"], "left_anti")


def run_isolation(df: DataFrame, group: str = "trace_id", order=("occurred_at", "n")) -> DataFrame:
    """Per group of runs: child runs, interleaved requests, leaks between runs, and a verdict.

    A run is a child if one of its start events says `concurrent_child`.
    """

    children = (
        df.filter((F.col("event_type") == "agent.run.started") & F.col("concurrent_child"))
        .select(group, "run_id")
        .distinct()
    )
    tagged = df.join(children.withColumn("child", F.lit(True)), [group, "run_id"], "left")
    tagged = tagged.withColumn("child", F.coalesce("child", F.lit(False)))
    requests = tagged.filter(
        F.col("child") & (F.col("event_type") == "tool.execution.requested")
    ).select(group, "run_id", *order)
    steps = in_order(requests, [group], list(order), {"before": ("lag", "run_id")})
    turns = steps.groupBy(group).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("before").isNotNull() & (F.col("before") != F.col("run_id"))).alias(
            "transitions"
        ),
    )
    stages = tagged.filter("child").groupBy(group, "run_id").agg(
        *[F.bool_or(F.col("event_type") == t).alias(f"l{i}") for i, t in enumerate(LIFECYCLE)]
    )
    whole = reduce(lambda a, b: a & b, [F.col(f"l{i}") for i in range(len(LIFECYCLE))])
    lacking = stages.groupBy(group).agg(
        F.count(F.lit(1)).alias("child_runs"), F.count_if(~whole).alias("incomplete_runs")
    )
    link = F.col("evidence_link")
    linked = tagged.filter(F.col("child") & link.isNotNull()).select(
        group, "event_id", "run_id", F.explode(
            F.array(link["subject_event_id"], link["evidence_event_id"])
        ).alias("target"),
    ).filter("target IS NOT NULL")
    where = df.select(F.col("event_id").alias("target"), F.col("run_id").alias("target_run"))
    crossing = (
        linked.join(where, "target")
        .filter(F.col("target_run") != F.col("run_id"))
        .groupBy(group)
        .agg(F.count_distinct("event_id").alias("cross_run_links"))
    )
    outside = tagged.groupBy(group).agg(
        F.count_if(
            ~F.col("child") & F.startswith(F.col("event_type"), F.lit("tool.execution."))
        ).alias("coordinator_tool_events")
    )
    joined = outside
    for part in (turns, lacking, crossing):
        joined = joined.join(part, group, "left")
    names = (
        "child_runs",
        "requests",
        "transitions",
        "incomplete_runs",
        "cross_run_links",
        "coordinator_tool_events",
    )
    rows = joined.select(group, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    return rows.withColumn(
        "ok",
        (F.col("child_runs") == 2)
        & (F.col("requests") >= 4)
        & (F.col("transitions") >= 2)
        & (F.col("incomplete_runs") == 0)
        & (F.col("cross_run_links") == 0)
        & (F.col("coordinator_tool_events") == 0),
    )


def first_failure(scores: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run the first failing score in ordinal order: its name and failure class."""

    bad = ~F.col("ok")
    return scores.groupBy(run).agg(
        F.min_by(
            F.struct("name", "failure_class"), F.when(bad, F.col("ordinal"))
        ).alias("first")
    ).select(
        run,
        F.col("first.name").alias("first_failing_scorer"),
        F.when(
            F.col("first").isNotNull(),
            F.coalesce("first.failure_class", F.lit("product_failure")),
        ).alias("score_class"),
    )


def classify_failures(runs: DataFrame, scores: DataFrame, run: str = "run_id") -> DataFrame:
    """Failure class per run: budget, provider, agent, harness, then the first failing score.

    `runs` holds the run and booleans budget_exhausted, provider_error, agent_error, harness_error.
    """

    joined = runs.join(first_failure(scores, run), run, "left")
    return joined.select(
        run,
        F.coalesce(
            F.when(F.col("budget_exhausted"), "inconclusive_budget_exhausted"),
            F.when(F.col("provider_error"), "provider_failure"),
            F.when(F.col("agent_error"), "agent_failure"),
            F.when(F.col("harness_error"), "harness_failure"),
            F.col("score_class"),
        ).alias("failure_class"),
    )


def failure_fingerprint(cards: DataFrame, scores: DataFrame, run: str = "run_id") -> DataFrame:
    """Digest of what failed in each scorecard; null where nothing did.

    A scorecard has one score per scorer, so its list stays as short as the
    list of scorers.
    """

    counted = scores.filter(~F.col("ok") | F.col("failure_class").isNotNull())
    listed = counted.groupBy(run).agg(
        F.array_sort(
            F.collect_list(F.struct("ordinal", "failure_class", "name", "ok"))
        ).alias("l")
    )
    entries = F.transform(
        F.coalesce("l", F.array().cast("array<struct<ordinal:bigint,failure_class:string,name:string,ok:boolean>>")),
        lambda s: F.struct(s["failure_class"].alias("failure_class"), s["name"].alias("name"), s["ok"].alias("ok")),
    )
    joined = cards.join(listed, run, "left")
    text = sorted_json(
        failure_class=F.col("failure_class"),
        passed=F.col("passed"),
        scenario_id=F.col("scenario_id"),
        scores=entries,
    )
    clean = F.col("passed") & F.col("failure_class").isNull()
    return joined.select(run, F.when(~clean, sha256_label(text)).alias("fingerprint"))


def scorecard_summary(cards: DataFrame, by=()) -> DataFrame:
    """Scorecards per failure class with how many passed."""

    return cards.groupBy(
        *by, F.coalesce("failure_class", F.lit("none")).alias("failure_class")
    ).agg(
        F.count(F.lit(1)).alias("scorecards"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.coalesce(F.sum("replay_count"), F.lit(0)).alias("replay_count"),
        F.coalesce(F.sum("replay_ok"), F.lit(0)).alias("replay_ok"),
    )


def event_type_coverage(df: DataFrame) -> DataFrame:
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


def transitions(df: DataFrame, run: str = "run_id", order=("sequence",)) -> DataFrame:
    """Counts of consecutive event types inside a run."""

    steps = in_order(df.select(run, "event_type", *order), [run], list(order), {"next_type": ("lead", "event_type")})
    return (
        steps.filter("next_type IS NOT NULL")
        .groupBy(F.concat_ws(" -> ", "event_type", "next_type").alias("transition"))
        .agg(F.count(F.lit(1)).alias("times"))
    )


def link_coverage(df: DataFrame) -> DataFrame:
    """Links by status, relationship and corroboration type, in one grouping-sets pass."""

    link = F.col("evidence_link")
    names = ("verification_status", "relationship", "corroboration_type")
    rows = df.filter(link.isNotNull()).select(
        *[F.coalesce(link[n], F.lit("unknown")).alias(n) for n in names]
    )
    sets = rows.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names])
    counts = sets.agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("links"))
    chosen = (
        F.when(F.col("g") == 3, names[0]).when(F.col("g") == 5, names[1]).otherwise(names[2])
    )
    return counts.select(chosen.alias("dimension"), F.coalesce(*names).alias("value"), "links")


def tool_identities(df: DataFrame, ids, payload: str = "payload") -> DataFrame:
    """Distinct (name, descriptor_hash) found at any depth, with the last server identity."""

    nodes = walk_json(
        df,
        list(ids),
        payload,
        keys=("name", "descriptor_hash", "server_identity"),
        kinds=("string", "number", "boolean"),
    )
    nodes = nodes.withColumnRenamed("up", "holder")
    objects = nodes.groupBy(*ids, "holder").agg(
        *[
            F.max(F.when(F.col("key") == k, F.col("text"))).alias(k)
            for k in ("name", "descriptor_hash", "server_identity")
        ]
    )
    found = objects.filter("name <> '' AND descriptor_hash <> ''")
    return found.groupBy("name", "descriptor_hash").agg(
        F.max_by(F.coalesce("server_identity", F.lit("")), F.struct(*ids, "holder")).alias(
            "server_identity"
        )
    )


def score_counts(scores: DataFrame) -> DataFrame:
    return scores.groupBy("name").agg(
        F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed")
    )


def trend_points(cards: DataFrame, audit: DataFrame, label: str) -> DataFrame:
    """One aggregate row per labelled set of runs; append it to the trend table."""

    rows = cards.select("passed", "replay_count", "replay_ok", F.lit(False).alias("leak"))
    leaks = audit.select(
        F.lit(True).alias("passed"),
        F.lit(0).cast("bigint").alias("replay_count"),
        F.lit(0).cast("bigint").alias("replay_ok"),
        F.lit(True).alias("leak"),
    )
    totals = rows.unionByName(leaks).agg(
        F.count_if(~F.col("leak")).alias("scenario_count"),
        F.count_if(~F.col("passed")).alias("failed_count"),
        F.coalesce(F.sum("replay_count"), F.lit(0)).alias("replay_count"),
        F.coalesce(F.sum("replay_ok"), F.lit(0)).alias("replay_ok"),
        F.count_if("leak").alias("leak_count"),
    )
    return totals.select(
        F.lit(label).alias("label"),
        "*",
        ((F.col("failed_count") == 0) & (F.col("leak_count") == 0)).alias("ok"),
    )


def replay_equivalence(expected: DataFrame, actual: DataFrame, key, fields) -> DataFrame:
    """Scorecards whose fields differ between an original run and its replay."""

    key = [key] if isinstance(key, str) else list(key)
    a = expected.select(*key, F.struct(*fields).alias("a"))
    b = actual.select(*key, F.struct(*fields).alias("b"))
    joined = a.join(b, key, "full")
    differing = F.filter(
        F.array(
            *[
                F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f))
                for f in sorted(fields)
            ]
        ),
        lambda f: f.isNotNull(),
    )
    return joined.select(
        *key, F.array_join(differing, ",").alias("mismatches"), (F.size(differing) == 0).alias("ok")
    )


def _differences(left: Counter, right: Counter) -> list:
    """(path, change, copies) between the nodes of one id, as a join of nodes by path has them.

    The counters hold (path, up, kind, text, members); several reports of one id give a
    copy for each way in which their nodes, and those of the parent, meet.
    """

    sides: dict = {}
    for side, counter in enumerate((left, right)):
        for (path, up, *rest), copies in counter.items():
            sides.setdefault((path, up), ([], []))[side].append((*rest, copies))
    # Members of a shared parent object count; what hangs under a missing or
    # retyped parent is told by the parent's own row.
    shared: Counter = Counter()
    for (path, _), (a, b) in sides.items():
        shared[path] += math.prod(sum(n for kind, _, _, n in own if kind == "object") for own in (a, b))
    out = []
    for (path, up), (a, b) in sides.items():
        parents = shared[up]
        if not a or not b:
            if parents:
                change = "removed" if a else "added"
                out.append((path, change, sum(node[3] for node in a or b) * parents))
            continue
        for kind, text, members, count in a:
            for other, other_text, other_members, other_count in b:
                copies = count * other_count * max(parents, 1)
                if kind != other:
                    out.append((path, "type", copies))
                elif kind == "array":
                    if members != other_members:
                        out.append((f"{path}.length", "length", copies))
                elif kind != "object" and text != other_text:
                    out.append((path, "value", copies))
    return out


def _pair_differences(left: str, right: str) -> list | None:
    """What `_differences` tells of two reports, without their nodes; None for texts it is left to.

    Only members that differ get a path. Captures and texts that may spell one with
    escapes, and invalid texts, are left to the nodes.
    """

    if left == right:
        return []
    if any("\\" in text or CAPTURE_MARKER in text for text in (left, right)):
        return None
    try:
        stack = [("$", strict_loads(left), strict_loads(right))]
    except (ValueError, RecursionError):
        return None
    out = []
    while stack:
        path, a, b = stack.pop()
        if type(a) is type(b) is dict:
            for key, value in a.items():
                if key not in b:
                    out.append((path + path_step(key), "removed", 1))
                elif type(value) in (dict, list) or value is not b[key]:
                    stack.append((path + path_step(key), value, b[key]))
            out.extend((path + path_step(key), "added", 1) for key in b if key not in a)
        elif type(a) is type(b) is list:
            if len(a) != len(b):
                out.append((f"{path}.length", "length", 1))
            stack.extend((f"{path}[{i}]", x, y) for i, (x, y) in enumerate(zip(a, b)))
        elif type(a) is type(b):
            # 0.0 and -0.0 are equal values with different texts.
            if a != b or type(a) is float and repr(a) != repr(b):
                out.append((path, "value", 1))
        elif {type(a), type(b)} == {int, float}:
            out.append((path, "value", 1))
        else:
            out.append((path, "type", 1))
    return out


def _node_counts(texts) -> Counter:
    found: Counter = Counter()
    for text in texts:
        for path, up, _, _, kind, shown, members, _ in json_nodes(text):
            found[path, up, "object" if kind == "capture" else kind, shown, members] += 1
    return found


def _diff_groups(width: int, schema, size: int = 8192):
    """mapInArrow function: rows of (ids, side, report) sorted by id to (ids, path, change)."""

    def same(one, other):
        return one == other or all(x == y or (x != x and y != y) for x, y in zip(one, other))

    def run(batches):
        import pyarrow as pa

        buffer = []

        def flush():
            batch = pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in buffer], type=f.type) for i, f in enumerate(schema)], schema=schema
            )
            buffer.clear()
            return batch

        def close(ids, single, counts):
            # A report without a counterpart has no shared parent and tells nothing.
            if counts is None:
                if single[0] is None or single[1] is None:
                    return
                found = _pair_differences(*single)
                if found is None:
                    found = _differences(*[_node_counts([text]) for text in single])
            else:
                found = _differences(*counts) if counts[0] and counts[1] else ()
            for path, change, copies in found:
                for _ in range(copies):
                    buffer.append((*ids, path, change))
                    if len(buffer) >= size:
                        yield flush()

        current, single, counts = None, [None, None], None
        for batch in batches:
            for *ids, side, text in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)]):
                if ids != current and (current is None or not same(ids, current)):
                    yield from close(current, single, counts)
                    current, single, counts = ids, [None, None], None
                if counts is not None:
                    counts[side].update(_node_counts([text]))
                elif single[side] is None:
                    single[side] = text
                else:
                    # Several reports of one id are held as the different nodes that they have.
                    counts = [_node_counts([t] if t is not None else []) for t in single]
                    counts[side].update(_node_counts([text]))
        yield from close(current, single, counts)
        if buffer:
            yield flush()

    return run


def json_diff(left: DataFrame, right: DataFrame, ids, col: str = "report") -> DataFrame:
    """Paths at which two JSON reports of the same id differ.

    One row per added or removed member (its own subtree is not listed again),
    changed value, changed type, or changed list length. The texts go through one
    shuffle by id and their nodes through none; a task compares one id at a time
    and holds the different nodes of that id.
    """

    from pyspark.sql.pandas.types import to_arrow_schema

    ids = list(ids)

    def side(df, number):
        # A null id equals none, and a null text has no nodes.
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*ids, col]])
        return df.filter(known).select(*ids, F.lit(number).alias("__side"), F.col(col).alias("__report"))

    both = side(left, 0).unionByName(side(right, 1))
    shape = T.StructType(
        [*both.schema.fields[: len(ids)], T.StructField("path", T.StringType()), T.StructField("change", T.StringType())]
    )
    dealt = both.repartition(*ids).sortWithinPartitions(*ids, "__side")
    return dealt.mapInArrow(_diff_groups(len(ids), to_arrow_schema(shape)), shape)


def input_drift(left: DataFrame, right: DataFrame) -> DataFrame:
    """(path, change) of inputs added, removed or changed by digest."""

    a = left.select("path", F.col("sha256").alias("a"))
    b = right.select("path", F.col("sha256").alias("b"))
    change = (
        F.when(F.col("a").isNull(), "added")
        .when(F.col("b").isNull(), "removed")
        .when(F.col("a") != F.col("b"), "changed")
    )
    return a.join(b, "path", "full").select("path", change.alias("change")).filter("change IS NOT NULL")


def drift_status(semantic: Column, inputs: Column, provenance: Column) -> Column:
    """matched, or the strongest kind of drift: semantic, input, provenance only."""

    return (
        F.when(semantic > 0, "semantic_drift")
        .when(inputs > 0, "input_drift")
        .when(provenance > 0, "provenance_only_drift")
        .otherwise("matched")
    )


def coverage_validate(covers: DataFrame, capabilities: DataFrame, declared: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(problem, capability, scenario_id) of a coverage table.

    covers: scenario -> capability; declared: capability -> scenario.
    """

    covers, declared = covers.distinct(), declared.distinct()
    caps = capabilities.select("capability").distinct()
    pair = ["capability", "scenario_id"]
    known = covers.join(caps, "capability", "left_semi")
    null = F.lit(None).cast("string")
    parts = [
        ("missing_capability", covers.join(caps, "capability", "left_anti").select(*pair)),
        (
            "stale_scenario",
            declared.join(caps, "capability", "left_semi")
            .join(scenarios.select("scenario_id").distinct(), "scenario_id", "left_anti")
            .select(*pair),
        ),
        (
            "uncovered_capability",
            caps.join(known, "capability", "left_anti").select("capability", null.alias("scenario_id")),
        ),
        ("declared_not_actual", declared.join(caps, "capability", "left_semi").join(known, pair, "left_anti").select(*pair)),
        ("actual_not_declared", known.join(declared, pair, "left_anti").select(*pair)),
    ]
    rows = [df.select(F.lit(name).alias("problem"), *pair) for name, df in parts]
    return reduce(lambda a, b: a.unionByName(b), rows)


SAFE_ARGUMENTS = ("mode", "path", "url")


def tool_calls(df: DataFrame, arguments: str = "arguments") -> DataFrame:
    """Calls with their argument names, and only the safe argument values."""

    value = F.try_parse_json(arguments)
    keys = F.array_sort(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")))
    safe = []
    for name in SAFE_ARGUMENTS:
        found = F.try_variant_get(value, f"$.{name}", "variant")
        is_text = F.schema_of_variant(found) == "STRING"
        safe.append(
            F.when(is_text, F.try_variant_get(found, "$", "string")).alias(f"safe_{name}")
        )
    return df.select(
        *[c for c in df.columns if c != arguments],
        F.array_join(keys, ",").alias("argument_keys"),
        *safe,
    )


# The artifact kinds an extension pack may hold.
PACK_KINDS = (
    "adapter",
    "contract",
    "detection_rule",
    "export_profile",
    "lab_corpus",
    "observer",
)


def pack_validate(manifest: DataFrame, files: DataFrame, schema_version: str, kinds=PACK_KINDS) -> DataFrame:
    """(pack_id, name, path, code) of every fault of a pack's artifacts.

    manifest: pack_id, schema_version, ordinal, kind, name, path, sha256;
    files: path, sha256 of what exists.
    """

    firsts = manifest.groupBy("pack_id", "kind", "name").agg(F.min("ordinal").alias("__first"))
    found = files.select("path", F.col("sha256").alias("__actual"))
    rows = manifest.join(firsts, ["pack_id", "kind", "name"]).join(found, "path", "left")
    path = F.col("path")
    unsafe = F.startswith(path, F.lit("/")) | (F.trim(path) == "") | F.array_contains(
        F.split(path, "/"), ".."
    )
    missing = ~unsafe & F.col("__actual").isNull()
    there = ~unsafe & ~missing & F.col("sha256").isNotNull()
    well_formed = F.col("sha256").rlike("^sha256:[0-9a-f]{64}$")
    codes = F.filter(
        F.array(
            *[
                F.when(test, F.lit(code))
                for code, test in (
                    ("duplicate_artifact", F.col("ordinal") > F.col("__first")),
                    ("unsupported_artifact_kind", ~F.col("kind").isin(*kinds)),
                    ("unsafe_artifact_path", unsafe),
                    ("artifact_missing", missing),
                    ("invalid_sha256_format", there & ~well_formed),
                    ("sha256_mismatch", there & well_formed & (F.col("sha256") != F.col("__actual"))),
                )
            ]
        ),
        lambda c: c.isNotNull(),
    )
    faults = rows.select("pack_id", "name", "path", F.explode(codes).alias("code"))
    null = F.lit(None).cast("string")
    versions = (
        manifest.filter(F.col("schema_version") != schema_version)
        .select("pack_id", null.alias("name"), null.alias("path"), F.lit("unsupported_schema_version").alias("code"))
        .distinct()
    )
    return faults.unionByName(versions)
