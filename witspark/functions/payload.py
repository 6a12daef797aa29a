"""Typed access to schemaless payloads held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from witspark.schema import ALWAYS_PRESENT, ENVELOPE_COLUMNS


def _key(part: str) -> str:
    if "'" in part or "\\" in part:
        raise ValueError(f"unsupported path part: {part!r}")
    return f"['{part}']"


def variant_at(value: Column, path: str) -> Column:
    """Sub-value at a dotted path; a decimal part is a list index or an object key."""

    plain = "$"
    for part in path.split("."):
        if part.isdecimal():
            if plain != "$":
                value = F.try_variant_get(value, plain, "variant")
            value = F.coalesce(
                F.try_variant_get(value, f"$[{int(part)}]", "variant"),
                F.try_variant_get(value, f"${_key(part)}", "variant"),
            )
            plain = "$"
        else:
            plain += _key(part)
    if plain != "$":
        value = F.try_variant_get(value, plain, "variant")
    return F.when(~F.is_variant_null(value), value)


def kind_of(value: Column) -> Column:
    """STRING, BIGINT, DOUBLE, DECIMAL, BOOLEAN, ARRAY, OBJECT or null."""

    return F.regexp_extract(F.schema_of_variant(value), r"^([A-Z]+)", 1)


NUMBERS = ("BIGINT", "DOUBLE", "DECIMAL")


def text_at(value: Column, path: str) -> Column:
    """Non-empty string at a path, else null: empty text counts as missing."""

    found = variant_at(value, path)
    text = F.try_variant_get(found, "$", "string")
    return F.when((kind_of(found) == "STRING") & (text != ""), text)


class Resolver:
    """Finds the value of a dotted event path on the flat event table.

    Envelope paths are real columns, so that filters on them reach the scan;
    all other paths, and envelope paths that are null, look into the payload.
    """

    def __init__(self, payload: str = "payload_v", columns: dict | None = None):
        self.payload_name = payload
        self.looked_up: dict = {}
        self.columns = ENVELOPE_COLUMNS if columns is None else columns

    def envelope(self, path: str) -> Column | None:
        name = self.columns.get(path)
        return None if name is None else F.col(name)

    def complete(self, path: str) -> bool:
        """Whether the path is an envelope column that is never null."""

        return path in self.columns and path in ALWAYS_PRESENT

    def inner(self, path: str) -> Column:
        if path in self.looked_up:
            return F.col(self.looked_up[path][0])
        return variant_at(F.col(self.payload_name), path.removeprefix("payload."))

    def kind(self, path: str) -> Column:
        if path in self.looked_up:
            return F.col(self.looked_up[path][1])
        return kind_of(self.inner(path))

    def prepared(self, df, paths):
        """`df` with each payload path looked up once, and a resolver over those columns."""

        ready = Resolver(self.payload_name, self.columns)
        added = []
        for i, path in enumerate(sorted(set(paths))):
            if self.complete(path):
                continue
            inner = self.inner(path)
            added += [inner.alias(f"__v{i}"), kind_of(inner).alias(f"__k{i}")]
            ready.looked_up[path] = (f"__v{i}", f"__k{i}")
        return df.select("*", *added), ready

    def text(self, path: str) -> Column:
        """Value as text; falsy and missing values become the empty string."""

        if self.complete(path):
            return F.coalesce(self.envelope(path).cast("string"), F.lit(""))
        inner, kind = self.inner(path), self.kind(path)
        shown = (
            F.when(kind == "STRING", F.try_variant_get(inner, "$", "string"))
            .when(kind == "BOOLEAN", F.when(F.try_variant_get(inner, "$", "boolean"), "True"))
            .when(
                kind.isin(*NUMBERS),
                F.when(F.try_variant_get(inner, "$", "double") != 0, F.to_json(inner)),
            )
            .otherwise(F.when(~F.to_json(inner).isin("[]", "{}"), F.to_json(inner)))
        )
        column = self.envelope(path)
        if column is not None:
            shown = F.coalesce(column.cast("string"), shown)
        return F.coalesce(shown, F.lit(""))
