"""Hash chains over event lines: assigning, verifying, anchoring, archiving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from witspark import schema as S
from witspark.functions.digest import hmac_sha256, sha256_label, sorted_json
from witspark.functions.times import canonical_ts
from witspark.operators.redact import with_redacted
from witspark.operators.validate import parse_events
from witspark.plans.lineage import broadcast_if_small, cut

ANCHOR_VERSION = f"{S.NAMESPACE}/anchor-v1"
ANCHOR_LOG_VERSION = f"{S.NAMESPACE}/anchor-log-v1"
SEGMENT_VERSION = f"{S.NAMESPACE}/segment-v1"
ARCHIVE_VERSION = f"{S.NAMESPACE}/archive-v1"
ATTESTATION_VERSION = f"{S.NAMESPACE}/anchor-attestation-v1"
IDENTITY_VERSION = f"{S.NAMESPACE}/journal-identity-v1"
SIGNATURE_ALGORITHM = "hmac-sha256"
RETENTION_MODES = ("none", "governance", "compliance", "legal_hold")

# In a canonical line `integrity` comes before `payload`, so the first match is
# the envelope's own member even if a payload holds the same text.
_HASH = r'^(.*?"integrity":\{"canonicalization":"[^"]*","event_hash":)"[^"]*"'
_OWN_HASH = r'^.*?"integrity":\{"canonicalization":"[^"]*","event_hash":"([^"]*)"'
_OPEN = '"event_hash":null,"previous_event_hash":null}'


def event_hash(line: Column) -> Column:
    """Digest of a canonical line with its own hash set to null."""

    return sha256_label(F.regexp_replace(line, _HASH, "$1null"))


CHAIN_SCHEMA = (
    "journal_id string, record_number bigint, previous_event_hash string, event_hash string, line string,"
    " expected bigint"
)
FAILED_SCHEMA = "journal_id string, record_number bigint, error string"


def _chain_partitions(batches):
    """mapInArrow function: link each line to the one before it in its journal.

    A journal's first row brings what is stored of it (`count`, `last`). A line whose
    number is not the next one is not linked: it comes out without hash and line and
    with the number that would have been right. A line with an error is passed over.
    """

    import hashlib

    import pyarrow as pa

    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    names = [f.split()[0] for f in CHAIN_SCHEMA.split(", ")]
    current, last, following = object(), None, 1
    for batch in batches:
        out = []
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for journal, number, head, tail, error, count, stored in zip(*columns):
            if error is not None:
                continue
            if journal != current:
                current, last, following = journal, stored, None if count is None else count + 1
            if following is None:
                following = number  # nothing is said of what is stored: any first number will do
            if number != following:
                out.append((journal, number, None, None, None, following))
                continue
            before = "null" if last is None else f'"{last}"'
            rest = f',"previous_event_hash":{before}}}{tail}'
            digest = hashlib.sha256(f'{head}"event_hash":null{rest}'.encode()).hexdigest()
            own = f"sha256:{digest}"
            out.append((journal, number, last, own, f'{head}"event_hash":"{own}"{rest}', None))
            last, following = own, following + 1
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], type=t) for i, t in enumerate(types)], names=names
            )


def _failed_partitions(batches):
    """mapInArrow function: the lines with an error, of rows dealt for `_chain_partitions`."""

    import pyarrow as pa

    names = [f.split()[0] for f in FAILED_SCHEMA.split(", ")]
    for batch in batches:
        rows = batch.filter(batch.column(4).is_valid())
        yield pa.RecordBatch.from_arrays([rows.column(i) for i in (0, 1, 4)], names=names)


def _dealt(df: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Lines in two halves around their hashes, by journal; `df` may have an `error`, null for sound lines."""

    place = F.position(F.lit(_OPEN), F.col("line"))
    parts = df.select(
        "journal_id",
        F.col("record_number").cast("bigint").alias("record_number"),
        F.substring(F.col("line"), F.lit(1), place - 1).alias("head"),
        F.substring(F.col("line"), place + len(_OPEN), F.length("line")).alias("tail"),
        (F.col("error") if "error" in df.columns else F.lit(None).cast("string")).alias("error"),
    )
    if ends is None:
        parts = parts.select(
            "*", F.lit(None).cast("bigint").alias("count"), F.lit(None).cast("string").alias("last")
        )
    else:
        stored = ends.select("journal_id", F.col("records").alias("count"), F.col("event_hash").alias("last"))
        parts = parts.join(stored, "journal_id", "left").withColumn("count", F.coalesce("count", F.lit(0)))
        parts = parts.select("journal_id", "record_number", "head", "tail", "error", "count", "last")
    return parts.repartition("journal_id")


def _linked(dealt: DataFrame) -> DataFrame:
    # The text orders lines that claim the same number, so that a repeated run refuses the same one.
    spread = dealt.sortWithinPartitions("journal_id", "record_number", "tail")
    return spread.mapInArrow(_chain_partitions, CHAIN_SCHEMA)


def assign_chain(df: DataFrame) -> DataFrame:
    """Chain canonical lines of whole journals: needs journal_id, record_number and line.

    Each hash covers the one before it, so one journal is one serial stream;
    it is streamed in order and never gathered. Everything that can run in
    parallel (redaction, canonical text) belongs before this step. Numbers must
    follow each other; `continue_chain` reports those that do not.
    """

    return _linked(_dealt(df.drop("error"))).filter("expected IS NULL").drop("expected")


def chain_ends(lines: DataFrame) -> DataFrame:
    """What is stored of each journal: `records` and the `event_hash` of its last record.

    An aggregate that combines before its shuffle; one row per journal, which may be
    kept and brought up to date by `newer_ends` without reading old lines again.
    """

    number = F.col("record_number").cast("bigint")
    own = F.nullif(F.regexp_extract("line", _OWN_HASH, 1), F.lit(""))
    return lines.groupBy("journal_id").agg(
        F.max(number).alias("records"), F.max_by(own, number).alias("event_hash")
    )


def newer_ends(ends: DataFrame, appended: DataFrame) -> DataFrame:
    """`ends` after the lines that `continue_chain` or `append_events` has appended."""

    both = ends.unionByName(chain_ends(appended))
    return both.groupBy("journal_id").agg(
        F.max("records").alias("records"), F.max_by("event_hash", "records").alias("event_hash")
    )


def continue_chain(df: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chain new lines behind the stored ones: (appended, refused).

    `ends` has one row per stored journal (`journal_id`, `records`, `event_hash`); a
    journal without one begins with record 1. The stored end is joined by journal, the
    key that the lines are dealt by anyway, and starts the fold. A line is appended if
    its number is the next one; else it is refused with the `expected` number, and the
    lines behind it are judged against that same number, as in appending one by one.
    """

    linked = cut(_linked(_dealt(df.drop("error"), ends)))
    refused = linked.filter("expected IS NOT NULL").select("journal_id", "record_number", "expected")
    return linked.filter("expected IS NULL").drop("expected"), refused


def append_events(df: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Redact, then chain behind the `stored` lines: (appended, failed with an `error` each).

    Nothing is appended to a journal whose stored lines fail verification; lines that
    cannot be redacted are left out before numbers are judged. Without stored lines both
    results take all columns of the same dealt rows, so that a plan that holds both
    redacts and shuffles the lines once.
    """

    safe = with_redacted(df, "line", "__r")
    if stored is None:
        told = safe.withColumn("line", F.col("__r.json")).withColumn("error", F.col("__r.error"))
        dealt = _dealt(told)
        appended = _linked(dealt).filter("expected IS NULL").drop("expected")
        return appended, dealt.mapInArrow(_failed_partitions, FAILED_SCHEMA)
    failed = safe.filter("__r.error IS NOT NULL").select(
        "journal_id", "record_number", F.col("__r.error").alias("error")
    )
    ready = safe.filter("__r.error IS NULL").withColumn("line", F.col("__r.json"))
    verdict = cut(
        verify_chain(stored).select(
            "journal_id", "ok", F.col("records_verified").alias("records"), F.col("last_event_hash").alias("event_hash")
        )
    )
    broken = verdict.filter("NOT ok").select("journal_id")
    barred = ready.join(broken, "journal_id", "left_semi").select(
        "journal_id", "record_number", F.lit("stored_chain_invalid").alias("error")
    )
    open_ = ready.join(broken, "journal_id", "left_anti")
    appended, refused = continue_chain(open_, verdict.filter("ok"))
    wrong = refused.select(
        "journal_id", "record_number", F.format_string("sequence_mismatch: expected record %d", "expected").alias("error")
    )
    return appended, failed.unionByName(barred).unionByName(wrong)


def record_issues(df: DataFrame) -> DataFrame:
    """Every record with its first issue code (null if sound), expected and actual values."""

    records = parse_events(df)
    before = df.select(
        "journal_id",
        (F.col("record_number") + 1).alias("record_number"),
        F.nullif(F.regexp_extract("line", _OWN_HASH, 1), F.lit("")).alias("prior_hash"),
    )
    joined = records.join(before, ["journal_id", "record_number"], "left")
    line = F.col("line")
    computed = event_hash(line)
    null = F.lit(None).cast("string")
    steps = [
        ("truncated_record", ~F.col("terminated"), null, null),
        ("empty_record", line == "", null, null),
        ("parse_error", F.col("error").isNotNull(), null, null),
        ("noncanonical_record", ~F.coalesce("canonical", F.lit(False)), null, null),
        (
            "sequence_mismatch",
            F.col("sequence") != F.col("record_number") - 1,
            (F.col("record_number") - 1).cast("string"),
            F.col("sequence").cast("string"),
        ),
        (
            "previous_hash_mismatch",
            ~F.col("previous_event_hash").eqNullSafe(F.col("prior_hash")),
            F.col("prior_hash"),
            F.col("previous_event_hash"),
        ),
        ("event_hash_missing", F.col("event_hash").isNull(), null, null),
        (
            "unsupported_canonicalization",
            F.col("canonicalization") != S.CANONICALIZATION,
            F.lit(S.CANONICALIZATION),
            F.col("canonicalization"),
        ),
        ("event_hash_mismatch", F.col("event_hash") != computed, computed, F.col("event_hash")),
    ]
    issue = F.coalesce(
        *[
            F.when(
                condition,
                F.struct(
                    F.lit(code).alias("code"),
                    expected.alias("expected"),
                    actual.alias("actual"),
                ),
            )
            for code, condition, expected, actual in steps
        ]
    )
    return joined.select(
        "journal_id", "record_number", "event_id", "event_hash", "prior_hash", issue.alias("issue")
    )


def verify_chain(df: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """One verdict per journal: everything before its first bad record is verified.

    Rows are checked in parallel; the link to the previous record is an equi
    join on (journal, number), which spreads a large journal like any other
    rows. `expected` may give trusted expected_count and expected_hash per journal.
    """

    rows = record_issues(df)
    bad = F.col("issue").isNotNull()
    verdict = rows.groupBy("journal_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.max_by("event_hash", "record_number").alias("end_hash"),
        F.min_by(
            F.struct("record_number", "event_id", "prior_hash", "issue.*"),
            F.when(bad, F.col("record_number")),
        ).alias("first_bad"),
    )
    verdict = verdict.select(
        "journal_id",
        F.coalesce(F.col("first_bad.record_number") - 1, "records").alias("records_verified"),
        F.when(F.col("first_bad").isNull(), F.col("end_hash"))
        .otherwise(F.col("first_bad.prior_hash"))
        .alias("last_event_hash"),
        F.col("first_bad.code").alias("issue_code"),
        F.col("first_bad.record_number").alias("record_number"),
        F.col("first_bad.event_id").alias("event_id"),
        F.col("first_bad.expected").alias("expected"),
        F.col("first_bad.actual").alias("actual"),
    )
    count_code, hash_code = F.lit(None).cast("string"), F.lit(None).cast("string")
    if expected is not None:
        verdict = expected.join(verdict, "journal_id", "full").withColumn(
            "records_verified", F.coalesce("records_verified", F.lit(0))
        )
        count_code = F.when(
            F.col("expected_count") != F.col("records_verified"), "expected_record_count_mismatch"
        )
        hash_code = F.when(
            F.col("expected_hash").isNotNull()
            & ~F.col("expected_hash").eqNullSafe(F.col("last_event_hash")),
            "expected_last_hash_mismatch",
        )
    codes = F.filter(F.array("issue_code", count_code, hash_code), lambda c: c.isNotNull())
    return verdict.select(
        "journal_id",
        (F.size(codes) == 0).alias("ok"),
        "records_verified",
        "last_event_hash",
        codes.alias("issues"),
        F.get(codes, F.lit(0)).alias("issue_code"),
        "record_number",
        "event_id",
        "expected",
        "actual",
    )


def first_corrupt(verdict: DataFrame) -> DataFrame:
    """The first issue of each journal that has one."""

    return verdict.filter(~F.col("ok")).select(
        "journal_id", "issue_code", "record_number", "event_id", "expected", "actual"
    )


def verified_prefix(df: DataFrame, verdict: DataFrame) -> DataFrame:
    """Lines before the first bad record of their journal."""

    # Counted for its size and joined: the verdict is computed once for both.
    bad = cut(
        verdict.filter("record_number IS NOT NULL").select(
            "journal_id", F.col("record_number").alias("bad_record")
        )
    )
    marked = df.join(broadcast_if_small(bad), "journal_id", "left")
    return marked.filter("bad_record IS NULL OR record_number < bad_record").drop("bad_record")


FANOUT = 2048


def ordered_digest(df: DataFrame, keys, number: str, content: Column, levels: int = 3) -> DataFrame:
    """Digest of all contents of a key in number order, as a tree of digests.

    A node covers at most FANOUT children, so that no task ever holds a whole
    journal. Where more than one node is left above the last level (with three
    levels: beyond eight billion records), the root covers all of them.
    """

    nodes = df.select(
        *keys, (F.col(number) - 1).cast("bigint").alias("__i"), F.sha2(content, 256).alias("__d")
    )
    for _ in range(levels):
        nodes = (
            nodes.groupBy(*keys, F.expr(f"__i div {FANOUT}").alias("__p"))
            .agg(F.array_sort(F.collect_list(F.struct("__i", "__d"))).alias("__l"))
            .select(
                *keys,
                F.col("__p").alias("__i"),
                F.sha2(F.array_join(F.transform("__l", lambda e: e["__d"]), ""), 256).alias("__d"),
            )
        )
    top = nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__i", "__d"))).alias("__l"))
    several = F.sha2(F.array_join(F.transform("__l", lambda e: e["__d"]), ""), 256)
    root = F.when(F.size("__l") == 1, F.col("__l")[0]["__d"]).otherwise(several)
    return top.select(*keys, F.concat(F.lit("sha256:"), root).alias("digest"))


def source_identity(df: DataFrame, verdict: DataFrame) -> DataFrame:
    """Path-independent identity of each verified journal."""

    content = ordered_digest(df, ["journal_id"], "record_number", F.col("line"))
    known = content.join(verdict.filter("ok"), "journal_id")
    text = sorted_json(
        journal_sha256=F.col("digest"),
        record_count=F.col("records_verified"),
        terminal_hash=F.col("last_event_hash"),
        version=F.lit(IDENTITY_VERSION),
    )
    return known.select(
        "journal_id",
        F.col("digest").alias("journal_sha256"),
        F.col("records_verified").alias("record_count"),
        F.col("last_event_hash").alias("terminal_hash"),
        F.concat(F.lit(f"{IDENTITY_VERSION}:"), sha256_label(text)).alias("identity"),
    )


def _anchor_json(signature: Column, algorithm: Column) -> Column:
    return sorted_json(
        anchor_version=F.col("anchor_version"),
        created_at=canonical_ts(F.col("created_at")),
        journal_path=F.col("journal_id"),
        last_event_hash=F.col("last_event_hash"),
        record_count=F.col("record_count"),
        signature=signature,
        signature_algorithm=algorithm,
    )




def _signature(key: bytes) -> Column:
    null = F.lit(None).cast("string")
    text = _anchor_json(null, F.lit(SIGNATURE_ALGORITHM))
    return F.concat(F.lit(f"{SIGNATURE_ALGORITHM}:"), hmac_sha256(key, text))


def create_anchors(verdict: DataFrame, created_at: Column, key: bytes | None = None) -> DataFrame:
    """Anchor rows of the sound journals, signed if a key is given."""

    anchors = verdict.filter("ok").select(
        "journal_id",
        F.col("records_verified").alias("record_count"),
        "last_event_hash",
        created_at.alias("created_at"),
        F.lit(ANCHOR_VERSION).alias("anchor_version"),
    )
    null = F.lit(None).cast("string")
    if key is None:
        return anchors.select("*", null.alias("signature_algorithm"), null.alias("signature"))
    return anchors.select(
        "*", F.lit(SIGNATURE_ALGORITHM).alias("signature_algorithm"), _signature(key).alias("signature")
    )


def _codes(*pairs) -> Column:
    found = F.array(*[F.when(condition, F.lit(code)) for code, condition in pairs])
    return F.filter(found, lambda c: c.isNotNull())


def verify_anchors(df: DataFrame, anchors: DataFrame, key: bytes | None = None) -> DataFrame:
    """Issue codes of each anchor against its journal: signature first, then the chain."""

    expected = anchors.select(
        "journal_id",
        F.col("record_count").alias("expected_count"),
        F.col("last_event_hash").alias("expected_hash"),
    )
    verdict = verify_chain(df, expected).select("journal_id", F.col("ok").alias("chain_ok"))
    joined = anchors.join(verdict, "journal_id", "left")
    signed = F.col("signature").isNotNull()
    no_key = signed if key is None else F.lit(False)
    wrong = F.lit(False) if key is None else signed & (F.col("signature") != _signature(key))
    return joined.select(
        "journal_id",
        _codes(
            ("signature_key_missing", no_key),
            ("signature_mismatch", wrong),
            ("journal_verification_failed", ~F.coalesce("chain_ok", F.lit(False))),
        ).alias("issues"),
    ).withColumn("ok", F.size("issues") == 0)


def _log_json(entry_hash: Column) -> Column:
    anchor = F.struct(
        F.col("anchor_version"),
        canonical_ts(F.col("created_at")).alias("created_at"),
        F.col("journal_id").alias("journal_path"),
        F.col("last_event_hash"),
        F.col("record_count"),
        F.col("signature"),
        F.col("signature_algorithm"),
    )
    return sorted_json(
        anchor=anchor,
        created_at=canonical_ts(F.col("logged_at")),
        entry_hash=entry_hash,
        log_version=F.lit(ANCHOR_LOG_VERSION),
        previous_entry_hash=F.col("previous_entry_hash"),
        sequence=F.col("sequence"),
    )


_LOG_OPEN = '"entry_hash":null,"log_version":"%s","previous_entry_hash":null' % ANCHOR_LOG_VERSION


def _log_partitions(batches):
    """mapInArrow function: link anchor log entries of each log."""

    import hashlib

    import pyarrow as pa

    current, last = None, None
    for batch in batches:
        out = []
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for log_id, sequence, head, middle, tail in zip(*columns):
            if log_id != current:
                current, last = log_id, None
            before = "null" if last is None else f'"{last}"'
            digest = hashlib.sha256(f"{head}null{middle}{before}{tail}".encode()).hexdigest()
            own = f"sha256:{digest}"
            out.append((log_id, sequence, last, own, f'{head}"{own}"{middle}{before}{tail}'))
            last = own
        if out:
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["log_id", "sequence", "previous_entry_hash", "entry_hash", "line"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], type=t) for i, t in enumerate(types)], names=names
            )


def append_anchor_log(anchors: DataFrame) -> DataFrame:
    """Chain anchors per log: needs log_id, sequence (from 1), logged_at and anchor columns."""

    null = F.lit(None).cast("string")
    texts = anchors.withColumn("previous_entry_hash", null).withColumn("line", _log_json(null))
    place = F.position(F.lit(_LOG_OPEN), F.col("line"))
    key = len('"entry_hash":')
    middle = f',"log_version":"{ANCHOR_LOG_VERSION}","previous_entry_hash":'
    parts = texts.select(
        F.col("log_id").cast("string").alias("log_id"),
        F.col("sequence").cast("bigint").alias("sequence"),
        F.substring(F.col("line"), F.lit(1), place + (key - 1)).alias("head"),
        F.lit(middle).alias("middle"),
        F.substring(F.col("line"), place + len(_LOG_OPEN), F.length("line")).alias("tail"),
    )
    spread = parts.repartition("log_id").sortWithinPartitions("log_id", "sequence")
    return spread.mapInArrow(
        _log_partitions,
        "log_id string, sequence bigint, previous_entry_hash string, entry_hash string, line string",
    )


def verify_anchor_log(df: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Verdict per log over (log_id, record_number, line); same shape as a chain verdict."""

    value = F.try_parse_json("line")
    entry = df.select("log_id", "record_number", "line", value.alias("v")).select(
        "log_id",
        "record_number",
        "line",
        F.try_variant_get("v", "$.sequence", "bigint").alias("sequence"),
        F.try_variant_get("v", "$.previous_entry_hash", "string").alias("previous_entry_hash"),
        F.try_variant_get("v", "$.entry_hash", "string").alias("entry_hash"),
        F.try_variant_get("v", "$.anchor.anchor_version", "string").alias("anchor_version"),
        F.try_variant_get("v", "$.anchor.record_count", "bigint").alias("record_count"),
        F.try_variant_get("v", "$.created_at", "string").alias("created_at"),
    )
    before = entry.select(
        "log_id",
        (F.col("record_number") + 1).alias("record_number"),
        F.col("entry_hash").alias("prior_hash"),
    )
    joined = entry.join(before, ["log_id", "record_number"], "left")
    computed = sha256_label(
        F.regexp_replace("line", r'^(.*?"entry_hash":)"[^"]*"(,"log_version")', "$1null$2")
    )
    malformed = (
        F.col("sequence").isNull()
        | F.col("anchor_version").isNull()
        | F.col("record_count").isNull()
        | F.col("created_at").isNull()
    )
    code = F.coalesce(
        F.when(F.col("line") == "", "empty_record"),
        F.when(malformed, "parse_error"),
        F.when(F.col("sequence") != F.col("record_number"), "sequence_mismatch"),
        F.when(
            ~F.col("previous_entry_hash").eqNullSafe(F.col("prior_hash")), "previous_hash_mismatch"
        ),
        F.when(F.col("entry_hash").isNull(), "entry_hash_missing"),
        F.when(F.col("entry_hash") != computed, "entry_hash_mismatch"),
    )
    rows = joined.withColumn("code", code)
    verdict = (
        rows.groupBy("log_id")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.max_by("entry_hash", "record_number").alias("end_hash"),
            F.min_by(
                F.struct("record_number", "code", "prior_hash"),
                F.when(F.col("code").isNotNull(), F.col("record_number")),
            ).alias("bad"),
        )
        .select(
            "log_id",
            F.coalesce(F.col("bad.record_number") - 1, "records").alias("records_verified"),
            F.when(F.col("bad").isNull(), F.col("end_hash"))
            .otherwise(F.col("bad.prior_hash"))
            .alias("last_entry_hash"),
            F.col("bad.code").alias("chain_code"),
            F.col("bad.record_number").alias("record_number"),
        )
    )
    count_bad, hash_bad = F.lit(False), F.lit(False)
    if expected is not None:
        verdict = expected.join(verdict, "log_id", "full").withColumn(
            "records_verified", F.coalesce("records_verified", F.lit(0))
        )
        count_bad = F.col("expected_count") != F.col("records_verified")
        hash_bad = F.col("expected_hash").isNotNull() & ~F.col("expected_hash").eqNullSafe(
            F.col("last_entry_hash")
        )
    codes = F.concat(
        F.filter(F.array("chain_code"), lambda c: c.isNotNull()),
        _codes(
            ("expected_record_count_mismatch", count_bad),
            ("expected_last_hash_mismatch", hash_bad),
        ),
    )
    return verdict.select(
        "log_id", "records_verified", "last_entry_hash", codes.alias("issues"), "record_number"
    ).withColumn("ok", F.size("issues") == 0)


def segment_manifests(df: DataFrame, size: int, created_at: Column) -> DataFrame:
    """One anchor per fixed-size segment of each journal."""

    return (
        df.groupBy("journal_id", F.expr(f"(record_number - 1) div {size}").alias("segment_index"))
        .agg(
            F.count(F.lit(1)).alias("record_count"),
            F.max_by("event_hash", "record_number").alias("last_event_hash"),
        )
        .select(
            "*", created_at.alias("created_at"), F.lit(SEGMENT_VERSION).alias("manifest_version")
        )
    )


def archive_manifest(
    df: DataFrame, verdict: DataFrame, uri: Column, retention: str = "none"
) -> DataFrame:
    """Archive manifest per sound journal: digest, size, count, last hash, retention."""

    if retention not in RETENTION_MODES:
        raise ValueError(f"unknown retention mode: {retention}")
    sizes = df.groupBy("journal_id").agg(
        F.sum(F.octet_length("line") + 1).alias("size_bytes")
    )
    content = ordered_digest(df, ["journal_id"], "record_number", F.col("line"))
    return (
        verdict.filter("ok")
        .join(sizes, "journal_id")
        .join(content, "journal_id")
        .select(
            "journal_id",
            uri.alias("object_uri"),
            F.col("digest").alias("journal_sha256"),
            "size_bytes",
            F.col("records_verified").alias("record_count"),
            "last_event_hash",
            F.lit(retention).alias("retention_mode"),
            F.lit(ARCHIVE_VERSION).alias("manifest_version"),
        )
    )


def verify_archives(manifests: DataFrame, df: DataFrame) -> DataFrame:
    """Issue codes of each manifest against the journals found."""

    content = ordered_digest(df, ["journal_id"], "record_number", F.col("line"))
    expected = manifests.select(
        "journal_id",
        F.col("record_count").alias("expected_count"),
        F.col("last_event_hash").alias("expected_hash"),
    )
    verdict = verify_chain(df, expected).select("journal_id", F.col("ok").alias("chain_ok"))
    joined = manifests.join(content, "journal_id", "left").join(verdict, "journal_id", "left")
    missing = F.col("digest").isNull()
    return joined.select(
        "journal_id",
        _codes(
            ("journal_file_missing", missing),
            ("journal_hash_mismatch", ~missing & (F.col("digest") != F.col("journal_sha256"))),
            (
                "journal_verification_failed",
                ~missing & ~F.coalesce("chain_ok", F.lit(False)),
            ),
        ).alias("issues"),
    ).withColumn("ok", F.size("issues") == 0)


def anchor_hash() -> Column:
    """Digest of the canonical text of an anchor row."""

    return sha256_label(_anchor_json(F.col("signature"), F.col("signature_algorithm")))


def attest_anchors(anchors: DataFrame, statements: DataFrame) -> DataFrame:
    """Sidecars binding each anchor to an external statement (journal_id, attester, statement)."""

    return anchors.join(statements.filter("trim(attester) <> ''"), "journal_id").select(
        "journal_id",
        anchor_hash().alias("anchor_hash"),
        "anchor_version",
        "attester",
        sha256_label(F.col("statement")).alias("statement_digest"),
        F.lit(ATTESTATION_VERSION).alias("attestation_version"),
    )


def verify_attestations(
    anchors: DataFrame, attestations: DataFrame, statements: DataFrame
) -> DataFrame:
    """Issue codes of each sidecar against its anchor and statement."""

    now = anchors.select(
        "journal_id",
        F.col("anchor_version").alias("now_version"),
        anchor_hash().alias("now_hash"),
    )
    texts = statements.select("journal_id", "statement")
    joined = attestations.join(now, "journal_id").join(texts, "journal_id", "left")
    return joined.select(
        "journal_id",
        _codes(
            (
                "unsupported_attestation_version",
                F.col("attestation_version") != ATTESTATION_VERSION,
            ),
            ("anchor_version_mismatch", F.col("anchor_version") != F.col("now_version")),
            ("anchor_hash_mismatch", F.col("anchor_hash") != F.col("now_hash")),
            (
                "statement_digest_mismatch",
                F.col("statement").isNotNull()
                & (F.col("statement_digest") != sha256_label(F.col("statement"))),
            ),
        ).alias("issues"),
    ).withColumn("ok", F.size("issues") == 0)


def health(verdict: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """ok or degraded per journal; the projection counts only where the journal is sound."""

    rows = verdict.select("journal_id", F.col("ok").alias("sound"))
    state = F.lit("healthy")
    if states is not None:
        rows = rows.join(states.select("journal_id", F.col("state").alias("__state")), "journal_id", "left")
        state = F.coalesce("__state", F.lit("projection_missing"))
    issue = F.when(~F.col("sound"), "journal_invalid").when(state != "healthy", state)
    return rows.select(
        "journal_id",
        F.when(issue.isNull(), "ok").otherwise("degraded").alias("state"),
        F.coalesce(issue, F.lit("")).alias("issue"),
    )


def projection_state(
    verdict: DataFrame, expected: DataFrame, actual: DataFrame, meta: DataFrame, columns
) -> DataFrame:
    """State of each journal's projection, with the columns of its first differing row.

    `expected` and `actual` hold journal_id, journal_record_number and `columns`;
    `meta` holds what the projection recorded: records_indexed, last_event_hash,
    source_identity (null: unknown) and the current identity in `identity`.
    """

    keys = ["journal_id", "journal_record_number"]
    left = expected.select(*keys, F.struct(*columns).alias("want"))
    right = actual.select(*keys, F.struct(*columns).alias("have"))
    pairs = left.join(right, keys, "full")
    differing = F.filter(
        F.array(
            *[
                F.when(~F.col(f"want.{c}").eqNullSafe(F.col(f"have.{c}")), F.lit(c))
                for c in columns
            ]
        ),
        lambda c: c.isNotNull(),
    )
    both = F.col("want").isNotNull() & F.col("have").isNotNull()
    number = F.col("journal_record_number")
    rows = pairs.withColumn("differing", F.when(both, differing))
    summary = rows.groupBy("journal_id").agg(
        F.count("want").alias("wanted"),
        F.count("have").alias("had"),
        F.max(F.when(F.col("have").isNotNull(), number)).alias("had_up_to"),
        F.min_by("differing", F.when(F.size("differing") > 0, number)).alias("columns"),
    )
    joined = (
        verdict.select("journal_id", "ok", "records_verified", F.col("last_event_hash").alias("now_hash"))
        .join(meta, "journal_id", "left")
        .join(summary, "journal_id", "left")
    )
    clean = F.col("columns").isNull()
    prefix = (
        clean
        & (F.col("records_indexed") <= F.col("records_verified"))
        & (F.col("had") == F.col("records_indexed"))
        & (F.col("had_up_to") == F.col("records_indexed"))
    )
    state = (
        F.when(~F.col("ok"), "journal_invalid")
        .when(F.col("records_indexed").isNull(), "projection_missing")
        .when(F.col("source_identity").isNull(), "projection_unavailable")
        .when(
            ~F.startswith(F.col("source_identity"), F.lit(IDENTITY_VERSION)),
            "projection_rebuild_required",
        )
        .when(
            F.col("source_identity") != F.col("identity"),
            F.when(prefix, "projection_stale").otherwise("projection_mismatch"),
        )
        .when(
            (F.col("records_indexed") != F.col("records_verified"))
            | ~F.col("last_event_hash").eqNullSafe(F.col("now_hash")),
            F.when(
                F.col("records_indexed") <= F.col("records_verified"), "projection_stale"
            ).otherwise("projection_mismatch"),
        )
        .when(
            F.col("had") != F.col("wanted"),
            F.when(F.col("had") < F.col("wanted"), "projection_stale").otherwise(
                "projection_mismatch"
            ),
        )
        .when(~clean, "projection_mismatch")
        .otherwise("healthy")
    )
    return joined.select(
        "journal_id",
        state.alias("state"),
        F.when(state == "projection_mismatch", F.array_join("columns", ",")).alias("columns"),
    )
