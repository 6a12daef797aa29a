"""Investigation graph: distinct nodes and edges of events, people, tools and resources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from witspark.operators.project import RESOURCE_KEYS, TOOL_KEYS, summary_values


#: Relationship and node kind of the values found in payloads, with the name of the
#: attribute that holds the value.
_FOUND = {"tool": ("uses_tool", "name"), "resource": ("references_resource", "identifier")}


def _entity(kind, value, attribute):
    """Node of a value; null where the value is null."""

    return F.when(
        value.isNotNull(),
        F.struct(
            F.concat(F.lit(f"{kind}:"), value).alias("id"),
            F.lit(kind).alias("kind"),
            value.alias("label"),
            F.to_json(F.struct(value.alias(attribute))).alias("attributes"),
        ),
    )


def _exploded(df: DataFrame, structs) -> DataFrame:
    """One row per struct that is not null, from one scan of `df`."""

    present = F.filter(F.array(*structs), lambda s: s.isNotNull())
    return df.select(F.explode(present).alias("s")).select("s.*")


def _deep_values(df: DataFrame) -> DataFrame:
    return summary_values(
        df, ["event_id"], "payload", {"tool": TOOL_KEYS, "resource": RESOURCE_KEYS}
    )


def graph_nodes(df: DataFrame) -> DataFrame:
    """Nodes (id, kind, label, attributes); referenced events not in the table included."""

    link = F.col("evidence_link")
    both = link["subject_event_id"].isNotNull() & link["evidence_event_id"].isNotNull()

    def reference(event_id):
        shown = F.struct(event_id.alias("event_id"), F.lit(False).alias("in_selected_timeline"))
        return F.struct(
            F.concat(F.lit("event:"), event_id).alias("id"),
            F.lit("event_reference").alias("kind"),
            event_id.alias("label"),
            F.to_json(shown).alias("attributes"),
        )

    event = F.struct(
        F.concat(F.lit("event:"), F.col("event_id")).alias("id"),
        F.lit("event").alias("kind"),
        F.col("event_type").alias("label"),
        F.to_json(F.struct("event_id", "event_type", "sequence", "verification_status")).alias("attributes"),
    )
    parent = F.col("parent_event_id")
    nodes = _exploded(
        df,
        [
            event,
            F.when(parent.isNotNull(), reference(parent)),
            F.when(both, reference(link["subject_event_id"])),
            F.when(both, reference(link["evidence_event_id"])),
            _entity("principal", F.col("principal_id"), "principal_id"),
            _entity("verification_status", F.col("verification_status"), "status"),
        ],
    )
    value, field = F.col("value"), F.col("field")
    deep = _exploded(
        _deep_values(df),
        [F.when(field == kind, _entity(kind, value, name)) for kind, (_, name) in _FOUND.items()],
    )
    # An event of the table stands before mere references to it ("event" is the lesser kind).
    merged = nodes.unionByName(deep).groupBy("id").agg(F.min(F.struct("kind", "label", "attributes")).alias("n"))
    return merged.select("id", "n.*")


def _edge(present, relationship, source, target, attributes=None):
    relation = F.lit(relationship) if isinstance(relationship, str) else relationship
    return F.when(
        present,
        F.struct(
            F.concat_ws(":", F.lit("edge"), relation, source, target).alias("id"),
            source.alias("src"),
            target.alias("dst"),
            relation.alias("relationship"),
            (F.lit("{}") if attributes is None else attributes).alias("attributes"),
        ),
    )


def _event(col):
    return F.concat(F.lit("event:"), F.col(col))


def graph_edges(df: DataFrame) -> DataFrame:
    """Edges (id, src, dst, relationship, attributes), one per id."""

    me = _event("event_id")
    link = F.col("evidence_link")
    safe = F.to_json(
        F.struct(
            *[
                link[name].alias(name)
                for name in (
                    "corroboration_type",
                    "observer_identity",
                    "confidence",
                    "verification_status",
                )
            ],
            F.when(F.size(link["limitations"]) > 0, link["limitations"]).alias("limitations"),
        )
    )
    edges = _exploded(
        df,
        [
            _edge(F.col("parent_event_id").isNotNull(), "causal_parent", _event("parent_event_id"), me),
            _edge(
                F.col("principal_id").isNotNull(),
                "performed_by",
                me,
                F.concat(F.lit("principal:"), F.col("principal_id")),
            ),
            _edge(
                F.col("verification_status").isNotNull(),
                "has_verification_status",
                me,
                F.concat(F.lit("verification_status:"), F.col("verification_status")),
            ),
            _edge(
                link["subject_event_id"].isNotNull() & link["evidence_event_id"].isNotNull(),
                F.concat(
                    F.lit("evidence_link:"), F.coalesce(link["relationship"], F.lit("evidence_link"))
                ),
                F.concat(F.lit("event:"), link["evidence_event_id"]),
                F.concat(F.lit("event:"), link["subject_event_id"]),
                safe,
            ),
        ],
    ).unionByName(
        _exploded(
            _deep_values(df),
            [
                _edge(F.col("field") == kind, relation, me, F.concat(F.lit(f"{kind}:"), F.col("value")))
                for kind, (relation, _) in _FOUND.items()
            ],
        )
    )
    kept = edges.groupBy("id").agg(
        F.min(F.struct("src", "dst", "relationship", "attributes")).alias("e")
    )
    return kept.select("id", "e.*")
