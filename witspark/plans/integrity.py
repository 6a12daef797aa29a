"""Hash chain queries over `conversations` seen as journals."""

import uuid

from pyspark.sql import functions as F

from witspark import schema as S
from witspark.operators import integrity as I
from witspark.operators.project import project
from witspark.operators.validate import parse_events
from witspark.plans.lineage import shared_folder, written_table
from witspark.plans.registry import query
from witspark.sources.journal import by_round, listing, write_case_bundles
from witspark.sources.tables import conversation_events, event_line, flat_events

AT_TEXT = "2025-01-01T00:00:00Z"
KEY = b"anchor test key"


def at():
    return F.timestamp_micros(F.lit(1_735_689_600_000_000))


def chained(spark, sf_dir):
    """Lines of all journals, chained once and kept on the shared folder."""
    return written_table(
        spark, "chained", sf_dir, lambda: I.assign_chain(event_line(conversation_events(spark, sf_dir)))
    )


def lines(spark, sf_dir):
    return chained(spark, sf_dir).withColumn("terminated", F.lit(True))


def tampered(spark, sf_dir):
    """Every eighth journal of seven kinds is damaged, each in its own way."""
    df = lines(spark, sf_dir).withColumn(
        "kind", F.regexp_extract("journal_id", "([0-9]+)", 1).cast("bigint") % 8
    )
    ends = df.groupBy("journal_id").agg(F.max("record_number").alias("turns"))
    df = df.join(ends, "journal_id")
    kind, number = F.col("kind"), F.col("record_number")
    df = df.filter(~((kind == 3) & (number == 2)))
    line = (
        F.when((kind == 1) & (number == 2), F.concat("line", F.lit(" ")))
        .when((kind == 2) & (number == 2), F.replace("line", F.lit('"turn":1}'), F.lit('"turn":7}')))
        .when((kind == 5) & (number == 2), F.lit(""))
        .when((kind == 6) & (number == 2), F.lit("{"))
        .when(
            (kind == 7) & (number == 3),
            F.regexp_replace("line", '"previous_event_hash":"[^"]*"', '"previous_event_hash":"sha256:0"'),
        )
        .otherwise(F.col("line"))
    )
    return df.select(
        "journal_id",
        F.when((kind == 3) & (number > 2), number - 1).otherwise(number).alias("record_number"),
        line.alias("line"),
        (~((kind == 4) & (number == F.col("turns")))).alias("terminated"),
    )


_BASE = """t AS (SELECT *, conv_id AS c, 'journal_' || conv_id AS journal_id, turn + 1 AS record_number,
  TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600 + turn) AS said FROM conversations),
 x AS (SELECT *, '{"causality":{"parent_event_id":' || CASE WHEN turn = 0 THEN 'null' ELSE
  '"msg_' || c || '_' || (turn - 1) || '"' END || ',"root_event_id":"msg_' || c || '_0","sequence":' || turn
  || '},"classification":{"sensitivity":"internal","trust":"local"},"correlation":{"run_id":"run_' || c
  || '","session_id":null,"span_id":null,"trace_id":"trace_' || c || '"},"event_id":"msg_' || c || '_' || turn
  || '","event_type":"' || CASE WHEN turn = 0 THEN 'agent.run.started' WHEN role = 'assistant'
  THEN 'tool.execution.acknowledged' ELSE 'agent.intent.recorded' END
  || '","integrity":{"canonicalization":"{CANON}",' AS head,
  ',"observed_at":"' || strftime(said, '%Y-%m-%dT%H:%M:%S') || '.500000Z","occurred_at":"'
  || strftime(said, '%Y-%m-%dT%H:%M:%S') || 'Z","payload":{"role":"' || role || '","text":'
  || CAST(to_json(text) AS VARCHAR) || ',"turn":' || turn || '},"principal":{"credential_id":null,"model_id":null,'
  || '"on_behalf_of":null,"principal_id":"' || role || '","principal_type":"'
  || CASE WHEN role = 'user' THEN 'human' ELSE 'model' END
  || '"},"source":{"component":"chat","instance_id":"chat_1","version":"1"},"spec_version":"{SPEC}"}' AS tail
  FROM t),
 ch AS (SELECT journal_id, record_number, NULL::VARCHAR AS prev,
  'sha256:' || sha256(head || '"event_hash":null,"previous_event_hash":null}' || tail) AS hash FROM x WHERE turn = 0
  UNION ALL SELECT x.journal_id, x.record_number, ch.hash, 'sha256:' || sha256(x.head
  || '"event_hash":null,"previous_event_hash":"' || ch.hash || '"}' || x.tail)
  FROM ch JOIN x ON x.journal_id = ch.journal_id AND x.record_number = ch.record_number + 1),
 ln AS (SELECT x.journal_id, x.record_number, ch.prev, ch.hash, x.head || '"event_hash":"' || ch.hash
  || '","previous_event_hash":' || coalesce('"' || ch.prev || '"', 'null') || '}' || x.tail AS line
  FROM x JOIN ch ON x.journal_id = ch.journal_id AND x.record_number = ch.record_number),
 j AS (SELECT journal_id, max(record_number) AS n, arg_max(hash, record_number) AS last FROM ch GROUP BY journal_id),
 v0 AS (SELECT j.*, CAST(substring(j.journal_id, 9) AS BIGINT) % 8 AS kind FROM j),
 v1 AS (SELECT *, CASE WHEN kind = 1 AND n >= 2 THEN 'noncanonical_record'
  WHEN kind = 2 AND n >= 2 THEN 'event_hash_mismatch' WHEN kind = 3 AND n >= 3 THEN 'sequence_mismatch'
  WHEN kind = 4 THEN 'truncated_record' WHEN kind = 5 AND n >= 2 THEN 'empty_record'
  WHEN kind = 6 AND n >= 2 THEN 'parse_error' WHEN kind = 7 AND n >= 3 THEN 'previous_hash_mismatch' END AS code,
  CASE kind WHEN 4 THEN n WHEN 7 THEN 3 ELSE 2 END AS bad_at FROM v0),
 vd AS (SELECT v1.journal_id, v1.code IS NULL AS ok, CASE WHEN code IS NULL THEN CASE WHEN kind = 3 AND n >= 2
  THEN n - 1 ELSE n END ELSE bad_at - 1 END AS verified, code,
  CASE WHEN code IS NOT NULL THEN bad_at END AS bad_at FROM v1),
 ver AS (SELECT vd.*, ch.hash AS last FROM vd LEFT JOIN ch ON ch.journal_id = vd.journal_id
  AND ch.record_number = vd.verified)"""
_BASE = _BASE.replace("{CANON}", S.CANONICALIZATION).replace("{SPEC}", S.SPEC_VERSION)
CHAIN = "WITH RECURSIVE " + _BASE


@query("int_canonical_json", f"{CHAIN} SELECT journal_id, record_number, sha256(line) AS digest FROM ln")
def canonical_json(spark, sf_dir):
    """Parsed and written again, every canonical line keeps its bytes."""
    from witspark.functions.jsonwalk import canonical_json as canonical

    loose = F.concat(F.lit("  "), F.regexp_replace("line", '^\\{"causality":', '{"causality" : '))
    return chained(spark, sf_dir).select(
        "journal_id", "record_number", F.sha2(canonical(loose), 256).alias("digest")
    )


@query("int_event_hash", f"{CHAIN} SELECT journal_id, record_number, hash AS computed FROM ch")
def event_hash(spark, sf_dir):
    return chained(spark, sf_dir).select(
        "journal_id", "record_number", I.event_hash(F.col("line")).alias("computed")
    )


@query(
    "int_chain_assign",
    f"{CHAIN} SELECT journal_id, record_number, prev AS previous_event_hash, hash AS event_hash,"
    " sha256(line) AS line_digest FROM ln",
)
def chain_assign(spark, sf_dir):
    df = I.assign_chain(event_line(conversation_events(spark, sf_dir)))
    return df.select(
        "journal_id",
        "record_number",
        "previous_event_hash",
        "event_hash",
        F.sha2("line", 256).alias("line_digest"),
    )


@query(
    "int_chain_continue",
    f"{CHAIN} SELECT journal_id, record_number, prev AS previous_event_hash, hash AS event_hash,"
    " sha256(line) AS line_digest FROM ln",
)
def chain_continue(spark, sf_dir):
    """Three slices of every journal, each chained behind the end of the slice before."""
    df = event_line(conversation_events(spark, sf_dir))
    number = F.col("record_number")
    ends = I.chain_ends(df.filter("false"))
    done = []
    for part in (number <= 2, (number > 2) & (number <= 5), number > 5):
        appended, _ = I.continue_chain(df.filter(part), ends)
        done.append(appended)
        ends = I.newer_ends(ends, appended)
    whole = done[0].unionByName(done[1]).unionByName(done[2])
    return whole.select(
        "journal_id",
        "record_number",
        "previous_event_hash",
        "event_hash",
        F.sha2("line", 256).alias("line_digest"),
    )


@query(
    "int_chain_refused",
    f"""{CHAIN} SELECT t.journal_id, t.record_number, 3::BIGINT AS expected FROM t
    WHERE conv_id % 5 = 2 AND t.record_number > 3
    UNION ALL SELECT journal_id, 2, 3 FROM t WHERE conv_id % 5 = 3 AND t.record_number = 2""",
)
def chain_refused(spark, sf_dir):
    """Lines that do not follow their stored journal: a missing third record, a repeated second one."""
    df = event_line(conversation_events(spark, sf_dir))
    number = F.col("record_number")
    kind = F.regexp_extract("journal_id", "([0-9]+)", 1).cast("bigint") % 5
    stored, _ = I.continue_chain(df.filter(number <= 2), I.chain_ends(df.filter("false")))
    later = df.filter((number > 2) & ~((kind == 2) & (number == 3)))
    again = df.filter((number == 2) & (kind == 3))
    _, refused = I.continue_chain(later.unionByName(again), I.chain_ends(stored))
    return refused


@query(
    "int_chain_verify",
    f"{CHAIN} SELECT journal_id, ok, verified AS records_verified, last AS last_event_hash,"
    " code AS issue_code, bad_at AS record_number FROM ver",
)
def chain_verify(spark, sf_dir):
    return I.verify_chain(tampered(spark, sf_dir)).select(
        "journal_id", "ok", "records_verified", "last_event_hash", "issue_code", "record_number"
    )


@query(
    "int_first_corrupt_record",
    f"{CHAIN} SELECT journal_id, code AS issue_code, bad_at AS record_number FROM ver WHERE NOT ok",
)
def first_corrupt(spark, sf_dir):
    found = I.first_corrupt(I.verify_chain(tampered(spark, sf_dir)))
    return found.select("journal_id", "issue_code", "record_number")


@query(
    "int_verified_prefix",
    f"{CHAIN} SELECT ver.journal_id, gs.i AS record_number FROM ver,"
    " generate_series(1::BIGINT, verified) gs(i)",
)
def verified_prefix(spark, sf_dir):
    df = tampered(spark, sf_dir)
    return I.verified_prefix(df, I.verify_chain(df)).select("journal_id", "record_number")


_TREE = (
    "tree AS (SELECT journal_id, 'sha256:' || sha256(sha256(sha256(string_agg(sha256(line), ''"
    " ORDER BY record_number)))) AS digest, sum(octet_length(encode(line)) + 1)::BIGINT AS size_bytes"
    " FROM ln GROUP BY journal_id)"
)


@query(
    "int_source_identity",
    f"""{CHAIN}, {_TREE} SELECT j.journal_id, digest AS journal_sha256, n AS record_count,
    last AS terminal_hash, '{I.IDENTITY_VERSION}:sha256:' || sha256('{{"journal_sha256":"' || digest
    || '","record_count":' || n || ',"terminal_hash":"' || last || '","version":"{I.IDENTITY_VERSION}"}}')
    AS identity FROM j JOIN tree ON tree.journal_id = j.journal_id""",
)
def source_identity(spark, sf_dir):
    df = lines(spark, sf_dir)
    return I.source_identity(df, I.verify_chain(df))


def _pad(byte):
    return "".join(f"\\x{b ^ byte:02X}" for b in KEY.ljust(64, b"\0"))


_ANCHOR = (
    f"""an AS (SELECT journal_id, n, last, '{{"anchor_version":"{I.ANCHOR_VERSION}","created_at":"{AT_TEXT}","journal_path":"'
    || journal_id || '","last_event_hash":"' || last || '","record_count":' || n || ',"signature":' AS head FROM j),
    sg AS (SELECT *, '{I.SIGNATURE_ALGORITHM}:' || sha256('{_pad(0x5C)}'::BLOB || unhex(sha256('{_pad(0x36)}'::BLOB
    || encode(head || 'null,"signature_algorithm":"{I.SIGNATURE_ALGORITHM}"}}')))) AS signature FROM an),
    ah AS (SELECT *, 'sha256:' || sha256(head || 'null,"signature_algorithm":null}}') AS anchor_hash FROM sg)"""
)


def anchors(spark, sf_dir, key=None):
    return I.create_anchors(I.verify_chain(lines(spark, sf_dir)), at(), key)


@query(
    "int_anchor_create",
    f"{CHAIN}, {_ANCHOR} SELECT journal_id, n AS record_count, last AS last_event_hash, signature FROM sg",
)
def anchor_create(spark, sf_dir):
    return anchors(spark, sf_dir, KEY).select(
        "journal_id", "record_count", "last_event_hash", "signature"
    )


@query(
    "int_anchor_verify",
    f"{CHAIN} SELECT v.journal_id, CASE WHEN CAST(substring(v.journal_id, 9) AS BIGINT) % 5 = 0"
    " THEN CASE WHEN v.ok AND v.verified = j.n THEN 'signature_mismatch'"
    " ELSE 'signature_mismatch,journal_verification_failed' END WHEN v.ok AND v.verified = j.n THEN ''"
    " ELSE 'journal_verification_failed' END AS issues FROM ver v JOIN j ON j.journal_id = v.journal_id",
)
def anchor_verify(spark, sf_dir):
    """Anchors of the sound journals against damaged ones; every fifth signature is forged."""
    signed = anchors(spark, sf_dir, KEY)
    forged = F.regexp_extract("journal_id", "([0-9]+)", 1).cast("bigint") % 5 == 0
    signed = signed.withColumn(
        "signature", F.when(forged, F.lit("hmac-sha256:00")).otherwise(F.col("signature"))
    )
    return I.verify_anchors(tampered(spark, sf_dir), signed, KEY).select(
        "journal_id", F.array_join("issues", ",").alias("issues")
    )


def _log_entries(spark, sf_dir):
    from pyspark.sql import Window as W

    number = F.regexp_extract("journal_id", "([0-9]+)", 1).cast("bigint")
    df = anchors(spark, sf_dir).select(
        "*", number.alias("num"), F.concat(F.lit("log_"), number % 10).alias("log_id"), at().alias("logged_at")
    )
    # Ten logs: at most a tenth of the anchors each, one row per journal.
    return df.withColumn(
        "sequence", F.row_number().over(W.partitionBy("log_id").orderBy("num")).cast("bigint")
    )


_LOG = (
    f"""lg0 AS (SELECT ah.*, CAST(substring(journal_id, 9) AS BIGINT) AS num FROM ah),
    lg1 AS (SELECT *, 'log_' || (num % 10) AS log_id, row_number() OVER (PARTITION BY num % 10 ORDER BY num) AS seq FROM lg0),
    lg2 AS (SELECT log_id, seq, '{{"anchor":' || head || 'null,"signature_algorithm":null}},"created_at":"{AT_TEXT}","entry_hash":null,"log_version":"{I.ANCHOR_LOG_VERSION}","previous_entry_hash":' AS lhead, ',"sequence":' || seq || '}}' AS ltail FROM lg1),
    lc AS (SELECT log_id, seq, NULL::VARCHAR AS prev, 'sha256:' || sha256(lhead || 'null' || ltail) AS hash FROM lg2 WHERE seq = 1
    UNION ALL SELECT lg2.log_id, lg2.seq, lc.hash, 'sha256:' || sha256(lhead || '"' || lc.hash || '"' || ltail)
    FROM lc JOIN lg2 ON lg2.log_id = lc.log_id AND lg2.seq = lc.seq + 1)"""
)


@query(
    "int_anchor_log_append",
    f"{CHAIN}, {_ANCHOR}, {_LOG} SELECT log_id, seq AS sequence, prev AS previous_entry_hash,"
    " hash AS entry_hash FROM lc",
)
def anchor_log_append(spark, sf_dir):
    return I.append_anchor_log(_log_entries(spark, sf_dir)).drop("line")


@query(
    "int_anchor_log_verify",
    f"""{CHAIN}, {_ANCHOR}, {_LOG}, lj AS (SELECT log_id, max(seq) AS n, arg_max(hash, seq) AS last FROM lc GROUP BY log_id)
    SELECT lj.log_id, CASE WHEN lj.log_id IN ('log_1', 'log_3') AND n >= 2 THEN 1 WHEN lj.log_id = 'log_2' AND n >= 3 THEN 2
    ELSE n END::BIGINT AS records_verified,
    CASE WHEN lj.log_id = 'log_1' AND n >= 2 THEN 'parse_error,expected_record_count_mismatch'
    WHEN lj.log_id = 'log_2' AND n >= 3 THEN 'entry_hash_mismatch,expected_record_count_mismatch'
    WHEN lj.log_id = 'log_3' AND n >= 3 THEN 'sequence_mismatch,expected_record_count_mismatch'
    WHEN lj.log_id = 'log_3' AND n = 2 THEN 'expected_record_count_mismatch'
    WHEN lj.log_id = 'log_4' THEN 'expected_last_hash_mismatch' ELSE '' END AS issues,
    CASE WHEN lj.log_id IN ('log_1', 'log_3') AND n >= 2 THEN a.hash WHEN lj.log_id = 'log_2' AND n >= 3 THEN b.hash
    ELSE last END AS last_entry_hash FROM lj JOIN lc a ON a.log_id = lj.log_id AND a.seq = 1
    LEFT JOIN lc b ON b.log_id = lj.log_id AND b.seq = 2""",
)
def anchor_log_verify(spark, sf_dir):
    """Logs damaged by unreadable text, a changed count, a removed entry, a wrong trusted end."""
    log = I.append_anchor_log(_log_entries(spark, sf_dir))
    ends = log.groupBy("log_id").agg(
        F.count(F.lit(1)).alias("expected_count"),
        F.max_by("entry_hash", "sequence").alias("expected_hash"),
    )
    ends = ends.withColumn(
        "expected_hash",
        F.when(F.col("log_id") == "log_4", "sha256:0")
        .when(F.col("log_id").isin("log_1", "log_2", "log_3"), F.lit(None))
        .otherwise(F.col("expected_hash")),
    )
    log_id, number = F.col("log_id"), F.col("sequence")
    log = log.filter(~((log_id == "log_3") & (number == 2)))
    line = (
        F.when((log_id == "log_1") & (number == 2), F.lit("[]"))
        .when(
            (log_id == "log_2") & (number == 3),
            F.regexp_replace("line", '"record_count":[0-9]+', '"record_count":99'),
        )
        .otherwise(F.col("line"))
    )
    rows = log.select(
        "log_id",
        F.when((log_id == "log_3") & (number > 2), number - 1).otherwise(number).alias("record_number"),
        line.alias("line"),
    )
    return I.verify_anchor_log(rows, ends).select(
        "log_id", "records_verified", F.array_join("issues", ",").alias("issues"), "last_entry_hash"
    )


@query(
    "int_segment_manifest",
    f"{CHAIN} SELECT journal_id, (record_number - 1) // 3 AS segment_index, count(*) AS record_count,"
    " arg_max(hash, record_number) AS last_event_hash FROM ch GROUP BY 1, 2",
)
def segment_manifest(spark, sf_dir):
    return I.segment_manifests(chained(spark, sf_dir), 3, at()).select(
        "journal_id", "segment_index", "record_count", "last_event_hash"
    )


@query(
    "int_archive_manifest",
    f"{CHAIN}, {_TREE} SELECT j.journal_id, 's3://archive/' || j.journal_id AS object_uri, digest AS"
    " journal_sha256, size_bytes, n AS record_count, last AS last_event_hash, 'compliance' AS retention_mode"
    " FROM j JOIN tree ON tree.journal_id = j.journal_id",
)
def archive_manifest(spark, sf_dir):
    df = lines(spark, sf_dir)
    uri = F.concat(F.lit("s3://archive/"), "journal_id")
    return I.archive_manifest(df, I.verify_chain(df), uri, "compliance").drop("manifest_version")


@query(
    "int_archive_verify",
    f"""{CHAIN} SELECT v.journal_id, CASE WHEN CAST(substring(v.journal_id, 9) AS BIGINT) % 9 = 0 THEN 'journal_file_missing'
    WHEN v1.kind IN (1, 2, 3, 5, 6) AND j.n >= 2 OR v1.kind = 7 AND j.n >= 3 THEN
    'journal_hash_mismatch,journal_verification_failed' WHEN v1.kind = 4 THEN 'journal_verification_failed'
    ELSE '' END AS issues FROM ver v JOIN j ON j.journal_id = v.journal_id JOIN v1 ON v1.journal_id = v.journal_id""",
)
def archive_verify(spark, sf_dir):
    """Manifests of the sound journals against damaged ones; every ninth file is gone."""
    df = lines(spark, sf_dir)
    manifests = I.archive_manifest(df, I.verify_chain(df), F.lit("s3://archive"))
    found = tampered(spark, sf_dir).filter(
        F.regexp_extract("journal_id", "([0-9]+)", 1).cast("bigint") % 9 != 0
    )
    return I.verify_archives(manifests, found).select(
        "journal_id", F.array_join("issues", ",").alias("issues")
    )


def _statements(anchors):
    return anchors.select(
        "journal_id",
        F.lit("notary").alias("attester"),
        F.concat(F.lit("statement about "), "journal_id").alias("statement"),
    )


@query(
    "int_attestation_link",
    f"{CHAIN}, {_ANCHOR} SELECT journal_id, anchor_hash, 'notary' AS attester, 'sha256:'"
    " || sha256('statement about ' || journal_id) AS statement_digest FROM ah",
)
def attestation_link(spark, sf_dir):
    rows = anchors(spark, sf_dir)
    return I.attest_anchors(rows, _statements(rows)).select(
        "journal_id", "anchor_hash", "attester", "statement_digest"
    )


@query(
    "int_attestation_verify",
    """SELECT 'journal_' || conv_id AS journal_id, CASE conv_id % 5 WHEN 1 THEN 'unsupported_attestation_version'
    WHEN 2 THEN 'anchor_version_mismatch,anchor_hash_mismatch' WHEN 3 THEN 'anchor_hash_mismatch'
    WHEN 4 THEN 'statement_digest_mismatch' ELSE '' END AS issues FROM conversations GROUP BY conv_id""",
)
def attestation_verify(spark, sf_dir):
    rows = anchors(spark, sf_dir).withColumn(
        "kind", F.regexp_extract("journal_id", "([0-9]+)", 1).cast("bigint") % 5
    )
    sidecars = I.attest_anchors(rows, _statements(rows)).join(rows.select("journal_id", "kind"), "journal_id")
    sidecars = sidecars.withColumn(
        "attestation_version",
        F.when(F.col("kind") == 1, "other/v9").otherwise(F.col("attestation_version")),
    ).drop("kind")
    now = rows.withColumn(
        "anchor_version", F.when(F.col("kind") == 2, "other/v9").otherwise(F.col("anchor_version"))
    ).withColumn("record_count", F.col("record_count") + F.when(F.col("kind") == 3, 1).otherwise(0))
    texts = _statements(rows).join(rows.select("journal_id", "kind"), "journal_id").withColumn(
        "statement", F.when(F.col("kind") == 4, "changed").otherwise(F.col("statement"))
    )
    return I.verify_attestations(now, sidecars, texts).select(
        "journal_id", F.array_join("issues", ",").alias("issues")
    )


def _states(spark, sf_dir):
    df = lines(spark, sf_dir)
    verdict = I.verify_chain(df)
    kind = F.regexp_extract("journal_id", "([0-9]+)", 1).cast("bigint") % 7
    rows = project(parse_events(df)).join(df.select("event_hash", "journal_id"), "event_hash")
    columns = ["event_id", "event_type", "sequence", "event_json"]
    expected = rows.select("journal_id", "journal_record_number", *columns)
    number = F.col("journal_record_number")
    actual = expected.filter(~((kind.isin(2, 3)) & (number > 1))).withColumn(
        "event_type", F.when((kind == 4) & (number == 1), "other").otherwise(F.col("event_type"))
    )
    first = df.filter("record_number = 1").select("journal_id", F.col("event_hash").alias("first_hash"))
    identity = I.source_identity(df, verdict)
    meta = identity.join(first, "journal_id").select(
        "journal_id",
        F.when(kind == 2, 1).otherwise(F.col("record_count")).cast("bigint").alias("records_indexed"),
        F.when(kind == 2, F.col("first_hash")).otherwise(F.col("terminal_hash")).alias("last_event_hash"),
        F.when(kind == 1, F.lit(None))
        .when(kind.isin(2, 5), F.concat(F.lit(I.IDENTITY_VERSION), F.lit(":sha256:old")))
        .when(kind == 6, "path:/old")
        .otherwise(F.col("identity"))
        .alias("source_identity"),
        "identity",
    )
    return verdict, I.projection_state(verdict, expected, actual, meta.filter(kind != 0), columns)


_STATE_SQL = """CASE c % 7 WHEN 0 THEN 'projection_missing' WHEN 1 THEN 'projection_unavailable'
 WHEN 2 THEN 'projection_stale' WHEN 3 THEN CASE WHEN n > 1 THEN 'projection_stale' ELSE 'healthy' END
 WHEN 4 THEN 'projection_mismatch' WHEN 5 THEN 'projection_stale' ELSE 'projection_rebuild_required' END"""


@query(
    "prj_projection_state",
    f"""WITH s AS (SELECT conv_id AS c, count(*) AS n FROM conversations GROUP BY conv_id)
    SELECT 'journal_' || c AS journal_id, {_STATE_SQL} AS state,
    CASE WHEN c % 7 = 4 THEN 'event_type' END AS columns FROM s""",
)
def projection_state(spark, sf_dir):
    return _states(spark, sf_dir)[1]


@query(
    "int_health_report",
    f"""WITH s AS (SELECT conv_id AS c, count(*) AS n FROM conversations GROUP BY conv_id),
    h AS (SELECT c, {_STATE_SQL} AS p FROM s)
    SELECT 'journal_' || c AS journal_id, CASE WHEN p = 'healthy' THEN 'ok' ELSE 'degraded' END AS state,
    CASE WHEN p = 'healthy' THEN '' ELSE p END AS issue FROM h""",
)
def health(spark, sf_dir):
    verdict, states = _states(spark, sf_dir)
    return I.health(verdict, states)


@query(
    "prj_case_bundle",
    f"""{CHAIN}, {_TREE} SELECT j.journal_id AS case_id, n AS events, size_bytes, digest
    FROM j JOIN tree ON tree.journal_id = j.journal_id""",
)
def case_bundle(spark, sf_dir):
    """Manifest figures of each case: events, bytes of its text and their ordered digest."""
    df = chained(spark, sf_dir)
    sizes = df.groupBy("journal_id").agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.octet_length("line") + 1).alias("size_bytes")
    )
    digests = I.ordered_digest(df, ["journal_id"], "record_number", F.col("line"))
    return sizes.join(digests, "journal_id").withColumnRenamed("journal_id", "case_id")


@query(
    "prj_case_bundle_files",
    f"""{CHAIN} SELECT journal_id AS case_id, 'events' AS part, count(*) AS lines,
    sum(octet_length(encode(line)) + 1)::BIGINT AS size_bytes FROM ln GROUP BY journal_id
    UNION ALL SELECT journal_id, 'summary', 1, octet_length(encode('{{"field":"records","value":"' || journal_id
    || '","events":' || count(*) || '}}')) + 1 FROM ln GROUP BY journal_id""",
)
def case_bundle_files(spark, sf_dir):
    """Case bundles written as files; lines read back, bytes from the manifest."""
    df = chained(spark, sf_dir)
    folder = f"{shared_folder(spark)}/bundles-{uuid.uuid4().hex[:12]}"
    summary = df.groupBy("journal_id").agg(F.count(F.lit(1)).alias("events")).select(
        "journal_id", F.lit("records").alias("field"), F.col("journal_id").alias("value"), "events"
    )
    events = df.select(
        "journal_id",
        F.timestamp_seconds("record_number").alias("occurred_at"),
        F.col("record_number").alias("sequence"),
        F.sha2("line", 256).alias("event_id"),
        "line",
    )
    manifest = write_case_bundles(events, folder, summary, by="journal_id")
    sizes = manifest.groupBy("case_id", "part").agg(F.sum("size_bytes").alias("size_bytes"))

    def counted(own):
        with listing(spark):
            lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(own)
        path = F.col("_metadata.file_path")
        return lines.groupBy(
            F.url_decode(F.regexp_extract(path, r"case_id=([^/]+)/", 1)).alias("case_id"),
            F.regexp_extract(path, r"/(events|summary)/case_id=", 1).alias("part"),
        ).agg(F.count(F.lit(1)).alias("lines"))

    # A case lies in one round, so a round's counts are whole.
    counts = by_round(spark, folder, counted)
    return counts.join(sizes, ["case_id", "part"])


@query(
    "int_append_events",
    "WITH {EV} SELECT run_id AS journal_id, count(*) AS appended, 0::BIGINT AS failed, max(sequence) + 1 AS last_record"
    " FROM evc GROUP BY run_id",
)
def append_events(spark, sf_dir):
    """Events redacted, chained and read back: records of each run, and those that failed."""
    lines = event_line(flat_events(spark, sf_dir)).select(
        F.col("run_id").alias("journal_id"), (F.col("sequence") + 1).alias("record_number"), "line"
    )
    good, bad = I.append_events(lines)
    appended = good.groupBy("journal_id").agg(
        F.count(F.lit(1)).alias("appended"), F.max("record_number").alias("last_record")
    )
    failed = bad.groupBy("journal_id").agg(F.count(F.lit(1)).alias("failed"))
    return appended.join(failed, "journal_id", "left").withColumn("failed", F.coalesce("failed", F.lit(0)))


def event_journals(spark, sf_dir):
    """Every run of `events` as a journal, chained once and kept on the shared folder."""

    def build():
        lines = event_line(flat_events(spark, sf_dir)).select(
            F.col("run_id").alias("journal_id"), (F.col("sequence") + 1).alias("record_number"), "line"
        )
        return I.assign_chain(lines)

    return written_table(spark, "event-journals", sf_dir, build).withColumn("terminated", F.lit(True))


@query(
    "int_chain_verify_events",
    "WITH {EV} SELECT run_id AS journal_id, min_by(event_type, sequence) IN ('agent.intent.recorded',"
    " 'agent.run.started', 'recorder.degraded') AS ok, CASE WHEN min_by(event_type, sequence) IN"
    " ('agent.intent.recorded', 'agent.run.started', 'recorder.degraded') THEN count(*) ELSE 0 END AS records_verified"
    " FROM evc GROUP BY run_id",
)
def chain_verify_events(spark, sf_dir):
    """Runs that open with no documented root fail to parse at their first record."""
    return I.verify_chain(event_journals(spark, sf_dir)).select("journal_id", "ok", "records_verified")
