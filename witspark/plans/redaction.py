"""Redaction, capture and leak queries over `documents`."""

from pyspark.sql import functions as F

from witspark.functions import redaction as R
from witspark.operators import redact
from witspark.plans.registry import query
from witspark.sources.tables import table

# A tail per document, so that every pattern has something to find. The pieces
# are joined here so that no whole secret-like text stands in this file.
_DASHES = "-" * 5
_TAIL = f"""text || CASE doc_id % 7
 WHEN 0 THEN ' Authorization: Bear' || 'er abcdefgh12345678 end'
 WHEN 1 THEN ' see postgres://user:pw@db.local/app now'
 WHEN 2 THEN ' https://x.example/?v=1&sig=abcdefghijkl&w=2'
 WHEN 3 THEN ' {_DASHES}BEGIN RSA PRIV' || 'ATE KEY{_DASHES}' || chr(10) || 'abc' || chr(10) || '{_DASHES}END RSA PRIV' || 'ATE KEY{_DASHES} end'
 WHEN 4 THEN ' api_key = "s3cr3tvalue99", my password: hunter2hunter2 end'
 WHEN 5 THEN ' gh' || 'p_abcdefghijklmnopqrst and WIT_' || 'CANARY_' || CAST(doc_id AS STRING)
 ELSE '' END"""


def texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "lang", "source", f"{_TAIL} AS text")


_DOCS = f"docs AS (SELECT doc_id, lang, source, {_TAIL} AS text FROM documents)"


def _re2(name, pattern):
    """The same pattern for an engine without lookaround: the guard becomes a captured prefix."""
    if name != "key_value_secret":
        return pattern
    return pattern.replace("(?<![A-Za-z0-9])(api", "(^|[^A-Za-z0-9])(api").replace("(?![A-Za-z0-9])", "")


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


def _redacted_sql(column, until=None):
    for name, pattern, shown in R.PATTERNS:
        if name == until:
            break
        if name == "key_value_secret":
            shown = r"\1\2=[REDACTED:secret]"
        column = f"regexp_replace({column}, {_quoted(_re2(name, pattern))}, {_quoted(shown)}, 'g')"
    return column


@query(
    "red_pattern_redact",
    f"WITH {_DOCS} SELECT doc_id, sha256({_redacted_sql('text')}) AS digest FROM docs",
)
def pattern_redact(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.sha2(R.redact_text(F.col("text")), 256).alias("digest"))


_HITS_SQL = " UNION ALL ".join(
    f"SELECT source, '{n}' AS pattern, len(regexp_extract_all({_redacted_sql('text', n)},"
    f" {_quoted(_re2(n, p))})) AS c FROM docs"
    for n, p, _ in R.PATTERNS
)


@query(
    "red_pattern_hits",
    f"WITH {_DOCS}, h AS ({_HITS_SQL}) SELECT source, pattern, sum(c)::BIGINT AS hits,"
    " count(*) AS rows FROM h WHERE c > 0 GROUP BY source, pattern",
)
def pattern_hits(spark, sf_dir):
    return redact.redaction_hits(texts(spark, sf_dir), "text", ["source"])


def _digest_sql(kind, content):
    return f"'sha256:' || sha256(encode('{R.DIGEST_SCOPE}') || '\\x00'::BLOB || encode('{kind}') || '\\x00'::BLOB || {content})"


@query(
    "red_bounded_capture_text",
    f"""SELECT doc_id, sha256(substring(text, 1, 4096)) AS value_digest, length(text) AS original_length,
    4096::BIGINT AS captured_length, {_digest_sql('text', 'encode(text)')} AS digest
    FROM documents WHERE length(text) > 4096""",
)
def capture_text(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", R.capture_text(F.col("text")).alias("c"))
    return df.filter("c IS NOT NULL").select(
        "doc_id",
        F.sha2("c.value", 256).alias("value_digest"),
        "c.original_length",
        "c.captured_length",
        "c.digest",
    )


@query(
    "red_bounded_capture_bytes",
    f"""SELECT doc_id, sha256(to_base64(CASE WHEN octet_length(encode(text)) <= 4096 THEN encode(text)
    ELSE unhex(substring(hex(encode(text)), 1, 8192)) END)) AS value_digest,
    octet_length(encode(text)) AS original_length,
    least(octet_length(encode(text)), 4096) AS captured_length,
    octet_length(encode(text)) > 4096 AS truncated,
    {_digest_sql('base64', 'encode(text)')} AS digest FROM documents""",
)
def capture_bytes(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(
        "doc_id", R.capture_bytes(F.encode("text", "UTF-8")).alias("c")
    )
    return df.select(
        "doc_id",
        F.sha2("c.value", 256).alias("value_digest"),
        "c.original_length",
        "c.captured_length",
        "c.truncated",
        "c.digest",
    )


@query(
    "red_capture_budget",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    c AS (SELECT doc_id, CASE WHEN length(line) > 200 THEN substring(line, 1, 200) END AS part FROM l),
    s AS (SELECT doc_id, count(part) AS captures, coalesce(sum(octet_length(encode(part))), 0)::BIGINT
    AS captured_bytes FROM c GROUP BY doc_id)
    SELECT *, captures <= 8 AND captured_bytes <= 1500 AS ok FROM s""",
)
def capture_budget(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    parts = lines.select("doc_id", R.capture_text(F.col("line"), 200)["value"].alias("part"))
    return redact.capture_budget(parts, ["doc_id"], "part", 8, 1500)


@query(
    "red_sensitive_field_redact",
    f"""SELECT doc_id, '{R.REDACTED_VALUE}' AS hidden, '{R.REDACTED_VALUE}' AS by_path,
    CAST(n_chars AS VARCHAR) AS kept, lang AS listed FROM documents""",
)
def sensitive_fields(spark, sf_dir):
    doc = F.struct(
        F.struct(F.col("text").alias("Api-Key"), F.col("n_chars")).alias("outer"),
        F.struct(F.col("source").alias("inner")).alias("by"),
        F.array(F.struct("lang")).alias("items"),
    )
    df = table(spark, sf_dir, "documents").select("doc_id", F.to_json(doc).alias("payload"))
    safe = redact.redact_fields(df, policy=R.Policy(sensitive_paths=frozenset({"by.inner"})))
    return safe.select(
        "doc_id",
        F.get_json_object("payload", "$.outer.Api-Key.value").alias("hidden"),
        F.get_json_object("payload", "$.by.inner.value").alias("by_path"),
        F.get_json_object("payload", "$.outer.n_chars").alias("kept"),
        F.get_json_object("payload", "$.items[0].lang").alias("listed"),
    )


@query(
    "red_structured_log_summary",
    f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_digest_sql('text', 'encode(text)')}
    ELSE '{R.LOG_DIGEST_UNAVAILABLE}' END AS digest, '{R.LOG_CAPTURE_VALUE}' AS value,
    CAST(length(text) AS VARCHAR) AS original_length FROM documents WHERE length(text) > 512""",
)
def log_summary(spark, sf_dir):
    """Odd documents carry a capture of an unknown scope; their digest is withheld."""
    df = table(spark, sf_dir, "documents").select("doc_id", R.capture_text(F.col("text"), 512).alias("c"))
    df = df.filter("c IS NOT NULL")
    mixed = F.when(F.col("doc_id") % 2 == 0, F.col("c")).otherwise(
        F.col("c").withField("digest_scope", F.lit("elsewhere"))
    )
    return df.select("doc_id", redact.log_safe(mixed).alias("s")).select(
        "doc_id", "s.digest", "s.value", "s.original_length"
    )


_CANARIES = ("password: hunter2", "no such text anywhere", "postgres://user")
_LEAK_SQL = " UNION ALL ".join(
    [f"SELECT doc_id, '{n}' AS pattern FROM docs WHERE regexp_matches(text, {_quoted(p)})" for n, p in R.LEAK_PATTERNS]
    + [
        f"SELECT doc_id, 'extra_canary_{i}' FROM docs WHERE contains(text, {_quoted(c)})"
        for i, c in enumerate(_CANARIES)
    ]
)


@query("red_leak_audit", f"WITH {_DOCS} {_LEAK_SQL}")
def leak_audit(spark, sf_dir):
    return redact.leak_audit(texts(spark, sf_dir), ["doc_id"], "text", _CANARIES)


def _many(spark, sf_dir):
    """Ten thousand literals: pieces of the benchmark's texts and others that occur nowhere."""
    items = table(spark, sf_dir, "benchmark").orderBy("item_id").limit(200).select("text").collect()
    known = [r["text"][at : at + 24] for r in items for at in range(0, 240, 24)]
    known = [c for c in known if len(c) == 24]
    return known + [f"no such literal {i}" for i in range(10_000 - len(known))]


@query(
    "red_leak_audit_many",
    """WITH b AS (SELECT text, row_number() OVER (ORDER BY item_id) AS rn FROM benchmark ORDER BY item_id LIMIT 200),
    p AS (SELECT rn, pos, substring(text, pos + 1, 24) AS c FROM b, unnest(range(0, 240, 24)) AS u(pos)),
    n AS (SELECT c, row_number() OVER (ORDER BY rn, pos) - 1 AS i FROM p WHERE length(c) = 24)
    SELECT doc_id, 'extra_canary_' || i AS pattern FROM documents, n WHERE contains(text, c)""",
)
def leak_audit_many(spark, sf_dir):
    """Ten thousand canaries in one pass over every text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = redact.leak_audit(docs, ["doc_id"], "text", _many(spark, sf_dir))
    return found.filter("pattern LIKE 'extra_canary_%'")
