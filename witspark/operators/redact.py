"""Redaction of fields and texts, capture budgets, log summaries and leak audits."""

from __future__ import annotations

import json
import re

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from witspark.functions import redaction as R
from witspark.functions.jsonwalk import (
    CAPTURE_MARKER, canonical_text, canonical_writer, settled_json, strict_loads, strict_reader
)


def _redactor(policy: R.Policy):
    """Function: JSON value -> (redacted value, captures, captured bytes).

    Works off a list of places (container and key) and writes each new value back
    where the old one was; the given value is changed.
    """

    import hashlib

    patterns = [(re.compile(p), shown) for _name, p, shown in R.PATTERNS]
    limits = {dict: policy.max_members, list: policy.max_items}
    hidden = {"marker": R.REDACTED_MARKER, "reason": "sensitive", "value": R.REDACTED_VALUE}

    def is_hidden(path):
        return bool(path) and (
            path[-1].replace("-", "_") in policy.sensitive_names or ".".join(path) in policy.sensitive_paths
        )

    def cut_text(text):
        digest = hashlib.sha256(f"{R.DIGEST_SCOPE}\0text\0".encode() + text.encode()).hexdigest()
        return {
            "marker": CAPTURE_MARKER,
            "encoding": "text",
            "value": text[: policy.max_text],
            "original_length": len(text),
            "captured_length": policy.max_text,
            "truncated": True,
            "digest": f"sha256:{digest}",
            "digest_scope": R.DIGEST_SCOPE,
        }

    def run(document):
        root = [document]
        places = [(root, 0, (), 0)]
        captures = []
        while places:
            holder, key, path, depth = places.pop()
            if is_hidden(path):
                holder[key] = dict(hidden)
                continue
            if depth > policy.max_depth:
                raise ValueError("too deep")
            value = holder[key]
            if type(value) in limits:
                if len(value) > limits[type(value)]:
                    raise ValueError("too many members or items")
                if isinstance(value, dict):
                    places.extend((value, k, (*path, k.lower()), depth + 1) for k in value)
                else:  # positions in a list are not part of the path
                    places.extend((value, i, path, depth + 1) for i in range(len(value)))
            elif isinstance(value, str):
                for pattern, shown in patterns:
                    value = pattern.sub(shown, value)
                if len(value) > policy.max_text and ".".join(path) not in policy.exempt_paths:
                    value = cut_text(value)
                    captures.append(len(value["value"].encode()))
                holder[key] = value
        if len(captures) > policy.max_captures or sum(captures) > policy.max_captured_bytes:
            raise ValueError("capture budget exceeded")
        return root[0], len(captures), sum(captures)

    return run


def _harmless(policy: R.Policy):
    """Function: text -> whether its redacted form is surely its canonical form.

    No sensitive name, no start of a pattern, and too short for a capture or a limit.
    """

    spelled, words = re.compile(_spelled(policy), re.I), _words(policy)

    def risky(text):
        if not text.isascii():
            return spelled.search(text)
        low = text.lower().replace("-", "_")
        return any(w in low for w in words) or "://" in text and any(f"{s}://" in low for s in _SCHEMES)

    shortest = min(policy.max_text, policy.max_members, policy.max_items, policy.max_depth)

    def test(text):
        return (
            len(text) <= policy.max_text
            and text.count(",") < shortest
            and text.count("{") + text.count("[") < policy.max_depth
            and not risky(text)
        )

    return test


def _spelled(policy: R.Policy) -> str:
    """Pattern of what a sensitive name or the start of a sensitive text may look like."""

    names = {n for n in policy.sensitive_names} | {p.rsplit(".", 1)[-1] for p in policy.sensitive_paths}
    spelled = "|".join(sorted({re.escape(n).replace("_", "[-_]").replace(r"\-", "[-_]") for n in names}))
    # A backslash may spell any of these otherwise.
    schemes = "|".join(map(re.escape, _SCHEMES))
    starts = rf"\\|-----BEGIN|bearer|(?:{schemes})://|=|key|token|secret|password|signature|[\u017f\u0131]"
    return f"{spelled}|{starts}" if spelled else starts


#: The schemes of the pattern `database_url`; other addresses are no secret by themselves.
_SCHEMES = (
    "postgres", "postgresql", "mysql", "mariadb", "mongodb", "mongodb+srv", "redis", "rediss", "amqp", "amqps"
)


def _surely_harmless(col: Column, policy: R.Policy) -> Column:
    """`_harmless` as a column, for texts of ASCII characters.

    Plain searches, as a pattern of so many names is tried anew at every character.
    """

    def count(mark):
        return F.length(col) - F.length(F.replace(col, F.lit(mark), F.lit("")))

    low = F.replace(F.lower(col), F.lit("-"), F.lit("_"))

    def risky(text):
        schemes = _any(F.contains(text, F.lit(f"{s}://")) for s in _SCHEMES)
        return _any(F.contains(text, F.lit(w)) for w in _words(policy)) | F.contains(text, F.lit("://")) & schemes

    # The lambda names the lowered text once, for all the searches in it.
    return (
        (F.length(col) <= policy.max_text)
        & (count(",") < min(policy.max_members, policy.max_items))
        & (count("[") + count("{") < policy.max_depth)
        & ~F.exists(F.array(low), risky)
    )


def _words(policy: R.Policy) -> list[str]:
    """Lower-case words, with "_" for "-", of which a risky text of ASCII characters holds one."""

    names = set(policy.sensitive_names) | {p.rsplit(".", 1)[-1] for p in policy.sensitive_paths}
    words = {n.lower().replace("-", "_") for n in names}
    words |= {"\\", "_____begin", "bearer", "=", "key", "token", "secret", "password", "signature"}
    # A word that holds another is found with it.
    return sorted(w for w in words if not any(o in w for o in words if o != w))


def _any(tests) -> Column:
    found = F.lit(False)
    for test in tests:
        found = found | test
    return found


def _redact_udf(policy: R.Policy):
    @F.pandas_udf("json string, captures bigint, captured_bytes bigint, error string")
    def redact(texts: pd.Series) -> pd.DataFrame:
        apply, harmless = _redactor(policy), _harmless(policy)
        read, write = strict_reader(), canonical_writer()
        rows = []
        for item in texts:
            if item is None:
                rows.append((None, 0, 0, None))
                continue
            try:
                if harmless(item):
                    rows.append((write(read(item)), 0, 0, None))
                    continue
                value, count, size = apply(read(item))
                rows.append((write(value), count, size, None))
            except (ValueError, RecursionError):
                rows.append((None, 0, 0, "redaction_failed"))
        return pd.DataFrame(rows, columns=["json", "captures", "captured_bytes", "error"])

    # Spark moves a filter on the result below the projection, and would run the function
    # in both; it moves no filter over a function that may give another result.
    return redact.asNondeterministic()


def _settled(col: Column, policy: R.Policy) -> Column:
    return F.when(_surely_harmless(col, policy), settled_json(col))


def _redacted(settled: Column, by_python: Column) -> Column:
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("string")
    done = F.struct(
        settled.alias("json"), zero.alias("captures"), zero.alias("captured_bytes"), none.alias("error")
    )
    return F.when(settled.isNotNull(), done).otherwise(by_python)


def redact_json(col: Column, policy: R.Policy = R.Policy()) -> Column:
    """Struct (json, captures, captured_bytes, error) of a JSON text.

    Fails closed: with an error the json member is null, never the input. The
    text comes out canonical, so that it can be hashed as it is. Texts that columns
    show to be harmless and can write canonically do not cross to Python.
    """

    settled = _settled(col, policy)
    return _redacted(settled, _redact_udf(policy)(F.when(settled.isNull(), col)))


def with_redacted(df: DataFrame, text: str, to: str, policy: R.Policy = R.Policy()) -> DataFrame:
    """`df` with the struct of `redact_json` of the column `text` in `to`.

    All texts cross to Python, which looks through a line of an event and writes it anew
    in a third of the time that columns take to show it harmless and canonical.
    """

    return df.withColumn(to, _redact_udf(policy)(F.col(text)))


def redact_fields(df: DataFrame, payload: str = "payload", policy: R.Policy = R.Policy()) -> DataFrame:
    """Replace the JSON text by its redacted form and add the `redaction_error` column."""

    return (
        with_redacted(df, payload, "__redacted", policy)
        .withColumn(payload, F.col("__redacted.json"))
        .withColumn("redaction_error", F.col("__redacted.error"))
        .drop("__redacted")
    )


def redaction_hits(df: DataFrame, text: str, by) -> DataFrame:
    """Replacements per pattern and group of rows; groups without any are left out."""

    # Each pattern counts on the text that the ones before it left behind.
    staged = df.select(*by, F.col(text).alias("__text"))
    for name, pattern, replacement in R.PATTERNS:
        staged = staged.withColumn(name, R.count_pattern(F.col("__text"), name, pattern))
        staged = staged.withColumn(
            "__text", R.replace_pattern(F.col("__text"), name, pattern, replacement)
        )
    each = F.array(
        *[
            F.struct(F.lit(name).alias("pattern"), F.col(name).alias("hits"))
            for name, _pattern, _replacement in R.PATTERNS
        ]
    )
    return (
        staged.select(*by, F.explode(F.filter(each, lambda e: e["hits"] > 0)).alias("e"))
        .groupBy(*by, "e.pattern")
        .agg(F.sum("e.hits").alias("hits"), F.count(F.lit(1)).alias("rows"))
    )


def capture_budget(
    df: DataFrame,
    ids,
    captured: str,
    max_count: int = R.MAX_CAPTURES,
    max_bytes: int = R.MAX_CAPTURED_BYTES,
) -> DataFrame:
    """Captured values and bytes per event, and whether they stay in the budget."""

    sums = df.groupBy(*ids).agg(
        F.count(captured).alias("captures"),
        F.coalesce(F.sum(F.octet_length(captured)), F.lit(0)).alias("captured_bytes"),
    )
    return sums.withColumn(
        "ok", (F.col("captures") <= max_count) & (F.col("captured_bytes") <= max_bytes)
    )


def log_safe(capture: Column) -> Column:
    """Log form of a capture struct: no captured value, digest only of the known scope."""

    return F.struct(
        F.lit(R.LOG_CAPTURE_MARKER).alias("marker"),
        F.lit(R.LOG_CAPTURE_VALUE).alias("value"),
        F.coalesce(capture["encoding"], F.lit("unknown")).alias("encoding"),
        F.coalesce(capture["original_length"].cast("string"), F.lit("unknown")).alias(
            "original_length"
        ),
        F.coalesce(capture["captured_length"].cast("string"), F.lit("unknown")).alias(
            "captured_length"
        ),
        F.coalesce(capture["truncated"].cast("string"), F.lit("unknown")).alias("truncated"),
        F.coalesce(capture["digest_scope"], F.lit("unknown")).alias("digest_scope"),
        F.when(capture["digest_scope"] == R.DIGEST_SCOPE, capture["digest"])
        .otherwise(R.LOG_DIGEST_UNAVAILABLE)
        .alias("digest"),
    )


def log_safe_json(col: Column, max_text: int = R.MAX_LOG_TEXT) -> Column:
    """Log form of a free JSON text: redacted, with every capture summarised."""

    policy = R.Policy(max_text=max_text)

    def summarise(value):
        if isinstance(value, list):
            return [summarise(v) for v in value]
        if not isinstance(value, dict):
            return value
        if value.get("marker") != CAPTURE_MARKER:
            return {k: summarise(v) for k, v in value.items()}

        def typed(name, kind):
            found = value.get(name)
            right = isinstance(found, kind) and (kind is bool or not isinstance(found, bool))
            return found if right else "unknown"

        known = value.get("digest_scope") == R.DIGEST_SCOPE and isinstance(value.get("digest"), str)
        return {
            "marker": R.LOG_CAPTURE_MARKER,
            "value": R.LOG_CAPTURE_VALUE,
            "encoding": typed("encoding", str),
            "original_length": typed("original_length", int),
            "captured_length": typed("captured_length", int),
            "truncated": typed("truncated", bool),
            "digest_scope": typed("digest_scope", str),
            "digest": value["digest"] if known else R.LOG_DIGEST_UNAVAILABLE,
        }

    failed = json.dumps(
        {
            "marker": R.LOG_FAILURE_MARKER,
            "reason": "redaction_failed",
            "value": "[REDACTION_FAILED]",
        },
        separators=(",", ":"),
    )

    @F.pandas_udf("string")
    def shorten(texts: pd.Series) -> pd.Series:
        apply = _redactor(policy)

        def one(text):
            if text is None:
                return None
            try:
                return canonical_text(summarise(apply(strict_loads(text))[0]))
            except (ValueError, RecursionError):
                return failed

        return texts.map(one)

    return shorten(col)


#: Up to so many literals are columns of the projection; more go through an automaton.
FEW_LITERALS = 16
#: Bytes of literals in one automaton, which is broadcast; more literals make several.
LITERAL_BYTES = 4 << 20


def _literal_blocks(literals: dict[str, list[int]]) -> list[dict[str, list[int]]]:
    blocks, size = [{}], 0
    for text, places in literals.items():
        own = len(text.encode())
        if blocks[-1] and size + own > LITERAL_BYTES:
            blocks.append({})
            size = 0
        blocks[-1][text] = places
        size += own
    return blocks


def literal_hits(spark, text: Column, literals: dict[str, list[int]]) -> list[Column]:
    """Arrays of the numbers whose literals a text holds; one array per block of literals.

    An Aho-Corasick automaton reads each text once, however many literals there are;
    it is built once per Python worker.
    """

    found = []
    for block in _literal_blocks(literals):
        shared = spark.sparkContext.broadcast(block)

        @F.pandas_udf("array<int>")
        def hits(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for literal, places in shared.value.items():
                automaton.add_word(literal, places)
            automaton.make_automaton()

            def one(item):
                if item is None:
                    return []
                return sorted({n for _, places in automaton.iter(item) for n in places})

            for series in texts:
                yield series.map(one)

        found.append(hits(text))
    return found


def leak_audit(df: DataFrame, ids, text: str, canaries=()) -> DataFrame:
    """(ids, pattern) of every text that holds a forbidden pattern or literal canary.

    Only the place and the pattern name are reported, never the match.
    """

    named = [(n, F.col(text).rlike("(?U)" + p)) for n, p in R.LEAK_PATTERNS]
    literals = [(i, c) for i, c in enumerate(canaries) if c]
    many = []
    if len(literals) <= FEW_LITERALS:
        named += [(f"extra_canary_{i}", F.contains(F.col(text), F.lit(c))) for i, c in literals]
    else:
        places: dict[str, list[int]] = {}
        for i, c in literals:
            places.setdefault(c, []).append(i)
        many = [
            F.transform(hits, lambda i: F.concat(F.lit("extra_canary_"), i.cast("string")))
            for hits in literal_hits(df.sparkSession, F.col(text), places)
        ]
    found = F.filter(F.array(*[F.when(hit, F.lit(name)) for name, hit in named]), lambda name: name.isNotNull())
    return df.select(*ids, F.explode(F.concat(found, *many) if many else found).alias("pattern"))
