"""One pass over free-form JSON texts: nodes, canonical text, redacted text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

NODE_FIELDS = [
    ("path", "string"),
    ("up", "string"),
    ("depth", "int"),
    ("key", "string"),
    ("kind", "string"),
    ("text", "string"),
    ("members", "bigint"),
    ("inside_capture", "boolean"),
]
CAPTURE_MARKER = "witspark.capture.v1"


def strict_loads(text: str):
    """Python value of a JSON text; duplicate keys and non-finite numbers are errors."""

    return strict_reader()(text)


def strict_reader():
    """`strict_loads` for many texts: the decoder is made once. It cannot be sent to a task."""

    def unique(pairs):
        value = dict(pairs)
        if len(value) != len(pairs):
            raise ValueError("duplicate key")
        return value

    def reject(token):
        raise ValueError(token)

    return json.JSONDecoder(object_pairs_hook=unique, parse_constant=reject).decode


def canonical_text(value) -> str:
    return canonical_writer()(value)


def canonical_writer():
    """`canonical_text` for many values: the encoder is made once. It cannot be sent to a task."""

    return json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), sort_keys=True, allow_nan=False).encode


def _kind(value) -> str:
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "array"
    if isinstance(value, str):
        return "string"
    if isinstance(value, bool):
        return "boolean"
    return "null" if value is None else "number"


def path_step(key: str) -> str:
    """A member in a path; a key that would read as more than one step is quoted."""

    if key == "" or any(c in key for c in '.[]"'):
        return f"[{json.dumps(key, ensure_ascii=False)}]"
    return f".{key}"


def _nodes(value, paths: bool = True):
    """Rows of one document, parents before children; keeps its own stack.

    Without `paths`, path and up stay empty.
    """

    stack = [("$" if paths else "", "", 0, None, value, False)]
    while stack:
        path, up, depth, key, node, inside = stack.pop()
        kind = _kind(node)
        marked = kind == "object" and node.get("marker") == CAPTURE_MARKER
        if kind in ("object", "array"):
            shown = None
            if marked:
                shown = json.dumps(
                    [node.get(n, "unknown") for n in ("original_length", "digest", "digest_scope")]
                )
        elif kind == "string":
            shown = node
        else:
            shown = json.dumps(node)
        size = len(node) if kind in ("object", "array") else None
        yield path, up, depth, key, "capture" if marked else kind, shown, size, inside
        if kind == "object":
            if paths:
                stack.extend(
                    (path + path_step(k), path, depth + 1, k, v, inside or marked) for k, v in node.items()
                )
            else:
                held = inside or marked
                stack.extend([("", "", depth + 1, k, v, held) for k, v in node.items()])
        elif kind == "array":
            stack.extend(
                (f"{path}[{i}]" if paths else "", path, depth + 1, None, v, inside) for i, v in enumerate(node)
            )


def json_nodes(text: str):
    """The nodes that `walk_json` gives of one text."""

    try:
        yield from _nodes(strict_loads(text))
    except (ValueError, RecursionError):
        yield "$", "", 0, None, "invalid", None, None, False


def _walk_batches(json_index: int, id_schema, keys, kinds, fields, size: int = 8192):
    def run(batches):
        import pyarrow as pa

        names = [name for name, _ in id_schema] + list(fields)
        arrow = {
            "string": pa.string(),
            "int": pa.int32(),
            "bigint": pa.int64(),
            "boolean": pa.bool_(),
        }
        of = dict(NODE_FIELDS)
        types = [t for _, t in id_schema] + [arrow[of[name]] for name in fields]
        all_names = [name for name, _ in NODE_FIELDS]
        places = [*range(json_index), *(json_index + all_names.index(name) for name in fields)]
        paths = "path" in fields or "up" in fields
        buffer = []

        def flush():
            batch = pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in buffer], type=t) for i, t in zip(places, types)],
                names=names,
            )
            buffer.clear()
            return batch

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*columns):
                ids, text = row[:json_index], row[json_index]
                if text is None:
                    continue
                try:
                    found = _nodes(strict_loads(text), paths)
                    for node in found:
                        if keys is not None and node[3] not in keys:
                            continue
                        if kinds is not None and node[4] not in kinds:
                            continue
                        buffer.append(ids + node)
                        if len(buffer) >= size:
                            yield flush()
                except (ValueError, RecursionError):
                    if keys is None and (kinds is None or "invalid" in kinds):
                        buffer.append(ids + ("$", "", 0, None, "invalid", None, None, False))
        if buffer:
            yield flush()

    return run


def walk_json(
    df: DataFrame, ids: list[str], json_col: str, *, keys=None, kinds=None, fields=None
) -> DataFrame:
    """One row per node of every JSON text: path, depth, key, kind, text, members.

    `keys` and `kinds` keep only nodes under such keys and of such kinds. A
    text that names none of the keys is dropped before it reaches Python; one
    with an escape may spell a key differently and is always walked. `fields`
    names the columns that are wanted; others are neither made nor sent.

    `kind` is object, array, string, number, boolean, null, capture (a bounded
    capture marker, whose text is the list of its length, digest and scope) or
    invalid (the text is no valid JSON).
    """

    from pyspark.sql.pandas.types import to_arrow_type

    source = df.select(*ids, json_col)
    if keys is not None:
        text = F.col(json_col)
        named = F.contains(text, F.lit("\\"))
        for key in keys:
            named = named | F.contains(text, F.lit(f'"{key}"'))
        source = source.filter(named)
    id_schema = [(f.name, to_arrow_type(f.dataType)) for f in source.schema.fields[: len(ids)]]
    wanted = [name for name, _ in NODE_FIELDS if fields is None or name in fields]
    shape = list(source.schema.fields[: len(ids)]) + [
        T.StructField(name, T._parse_datatype_string(dict(NODE_FIELDS)[name])) for name in wanted
    ]
    return source.mapInArrow(
        _walk_batches(
            len(ids),
            id_schema,
            None if keys is None else frozenset(keys),
            None if kinds is None else frozenset(kinds),
            wanted,
        ),
        T.StructType(shape),
    )


def json_sizes(df: DataFrame, ids: list[str], json_col: str) -> DataFrame:
    """One row per JSON text: depth, members of its largest object, longest array, and whether it is valid.

    The figures of the nodes that `walk_json` gives, taken where a text is walked, so
    that a text sends one row and not one per node. A null text has no row.
    """

    from pyspark.sql.pandas.types import to_arrow_schema

    source = df.select(*ids, json_col)
    sizes = T._parse_datatype_string("max_depth bigint, max_members bigint, max_array bigint, parsed boolean")
    shape = T.StructType([*source.schema.fields[: len(ids)], *sizes.fields])
    arrow = to_arrow_schema(shape)

    def one(text):
        depth = members = items = 0
        try:
            for _, _, level, _, kind, _, size, _ in _nodes(strict_loads(text), paths=False):
                if level > depth:
                    depth = level
                if size is not None:
                    if kind == "object":
                        members = max(members, size)
                    elif kind == "array":
                        items = max(items, size)
        except (ValueError, RecursionError):
            return depth, members, items, False
        return depth, members, items, True

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            batch = batch.filter(batch.column(len(ids)).is_valid())
            found = [one(text) for text in batch.column(len(ids)).to_pylist()]
            columns = [pa.array([f[i] for f in found], type=arrow.field(len(ids) + i).type) for i in range(4)]
            own = [batch.column(i).cast(arrow.field(i).type) for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([*own, *columns], schema=arrow)

    return source.mapInArrow(run, shape)


def settled_json(col: Column) -> Column:
    """Canonical text of the texts that columns alone can settle; null for all others.

    Written back from VARIANT, keys come sorted and nothing stands between. That is the
    canonical text where all characters are printable ASCII without escapes, numbers
    are short, and nothing but the order of members differs: text and result then have
    the same length, which something left over behind a value never has. A number with
    up to eleven digits before the point and four behind it, the last not zero, is the
    shortest text of its double, and no exponent is written for it.
    """

    bare = F.regexp_replace(col, '"[^"]*"', '""')
    plain = col.rlike(r"^[\x20-\x5b\x5d-\x7e]*$")
    simple = ~bare.rlike(r"[0-9][eE]|\.(?![0-9]{0,3}[1-9](?![0-9]))|[0-9]{12}\.|[0-9]{16}|\s")
    opened = [F.length(col) - F.length(F.replace(col, F.lit(mark), F.lit(""))) for mark in "[{"]
    shallow = opened[0] + opened[1] <= 200
    written = F.array(F.to_json(F.try_parse_json(col)))
    # The lambda names the written text once, though the step looks at it twice.
    kept = F.transform(written, lambda text: F.when(F.length(text) == F.length(col), text))
    return F.when(plain & simple & shallow, F.get(kept, F.lit(0)))


def canonical_json(col: Column) -> Column:
    """Text with sorted keys, no spaces and kept Unicode; null for invalid JSON.

    Only texts that columns cannot settle cross to Python.
    """

    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            try:
                return canonical_text(strict_loads(text))
            except (ValueError, RecursionError):
                return None

        return texts.map(one)

    settled = settled_json(col)
    return F.coalesce(settled, canonical(F.when(settled.isNull(), col)))
