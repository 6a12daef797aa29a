"""Near-dedup by NN-descent and whitening by FEAST, against brute force."""

import math

import numpy as np
import pytest

from witspark.llm import descent, feast
from witspark.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id bigint, embedding array<double>, label int, node string, id int, wide int, x int, v int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, 2, 3, 4) for r in rows], SCHEMA)


def brute(rows, threshold=0.93):
    """n_links and component of each row, by comparing all pairs."""

    def unit(v):
        if not v or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            return None
        x = np.array(v) / np.abs(v).max()
        return x / np.linalg.norm(x)

    units = [unit(v) for _, v, _ in rows]
    n = len(rows)
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(n):
            same = rows[i][2] is not None and rows[i][2] == rows[j][2]
            if i != j and same and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]):
                if units[i] @ units[j] >= threshold:
                    links[i].append(j)
    comp = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([comp[i], *(comp[j] for j in links[i])])
            changed |= low != comp[i]
            comp[i] = low
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[comp[i]] = min(rows[i][0], least.get(comp[i], rows[i][0]))
    out = [(rows[i][0], len(links[i]), least.get(comp[i])) for i in range(n)]
    return sorted([(i, k, c, i == c) for i, k, c in out], key=str)


def found(spark, rows, **more):
    got = descent.near_duplicates(table(spark, rows), **more).collect()
    return sorted([(r.id, r.n_links, r.component, r.kept) for r in got], key=str)


def test_odd_vectors(spark):
    big = [1e300, -1e300, 2e300]
    rows = [
        (1, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 2), (4, [1.0, 0.0, 0.0], None),
        (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 0.0], 1), (9, [math.nan, 1.0, 0.0], 1),
        (10, [math.inf, 1.0, 0.0], 1), (11, [1.0, 0.0], 1), (12, big, 1), (13, [1e-300, -1e-300, 2e-300], 1),
        (14, [1.0, 0.0, 0.0], 1), (14, [1.0, 0.0, 0.0], 1), (None, [0.0, 1.0, 0.0], 3), (20, [0.0, 1.0, 0.01], 3),
        (None, [0.0, 0.0, 1.0], 4), (30, [0.0, 1.0, 1.0], 5), (31, [0.0, 1.0, 1.0], 5),
    ]
    assert found(spark, rows) == brute(rows)


def test_clusters_wider_than_a_list(spark):
    """A hot label with a cluster of 90 vectors, chains, and vectors alone."""

    r = np.random.default_rng(3)
    rows, centre = [], r.standard_normal(24)
    for k in range(90):
        rows.append((k, (centre + 0.12 * r.standard_normal(24)).tolist(), 1))
    for k in range(300):
        rows.append((1000 + k, r.standard_normal(24).tolist(), 1 + (k % 3 == 0)))
    for k in range(0, 60, 2):  # chains of neighbours, each a small turn further
        a, b = r.standard_normal(24), r.standard_normal(24)
        for step in range(4):
            rows.append((2000 + 4 * k + step, (a + 0.25 * step * b).tolist(), 2))
    expected = brute(rows)
    assert max(k for _, k, _, _ in expected) > 2 * descent.WIDTH
    assert found(spark, rows) == expected


def test_empty_table(spark):
    assert found(spark, []) == []
    assert feast.whiten(table(spark, []), feast.fit(table(spark, []))).count() == 0


def test_starts_stay_small_in_a_hot_region(spark):
    """Nodes with nearly the same sketch are dealt over several blocks."""

    r = np.random.default_rng(5)
    centre = r.standard_normal(16)
    rows = [(k, (centre + 0.001 * r.standard_normal(16)).tolist(), 1) for k in range(2000)]
    _, nodes = descent.nodes_of(table(spark, rows), "vec_id", "embedding", "label")
    edges = descent.starts(nodes, 0)
    assert edges.groupBy("node").count().agg({"count": "max"}).first()[0] <= 2 * descent.FOLLOWERS


def test_audit_counts_missing_links(spark):
    rows = [(k, [1.0, 0.001 * k], 1) for k in range(20)]
    _, nodes = descent.nodes_of(table(spark, rows), "vec_id", "embedding", "label")
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert descent.audit(nodes, none, 0.93) == (190, 0)
    assert descent.audit(nodes, descent.links_of(nodes, 0.93), 0.93) == (190, 190)


def test_bit_bound_rises_with_the_angle():
    bounds = [descent.bit_bound(t) for t in (0.999, 0.93, 0.5, -0.5)]
    assert bounds == sorted(bounds)
    assert bounds[-1] <= descent.BITS


def test_near_dedup_query_equals_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    rows = QUERIES["op11_embedding_near_dedup"](spark, sf_dir)
    sql = con.execute(ORACLES["op11_embedding_near_dedup"])
    names = [c[0] for c in sql.description]
    assert sorted(map(tuple, rows.select(names).collect())) == sorted(sql.fetchall())


# Whitening


def whitened_by_numpy(vectors, wanted=4):
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1][:wanted], directions[:, ::-1][:, :wanted]
    away = ((n * x - sums) ** 2).sum(1)
    return n, away, (x - sums / n) @ directions / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def check_against_numpy(rows, ids, vectors):
    n, away, projected, shares = whitened_by_numpy(vectors)
    at = {}
    for k, i in enumerate(ids):
        at.setdefault(i, []).append(k)
    sign = {}
    assert len(rows) == len(ids) * projected.shape[1]
    for r in rows:
        c = r.component - 1
        assert r.n == n and r.deviation in {int(away[k]) for k in at[r[0]]}
        assert r.explained == pytest.approx(shares[c], rel=1e-10)
        assert r.identity_error < 1e-9
        own = projected[at[r[0]][0], c]
        assert abs(r.whitened) == pytest.approx(abs(own), abs=1e-8)
        if abs(own) > 1e-6:
            assert sign.setdefault(c, np.sign(own * r.whitened)) == np.sign(own * r.whitened)


def test_whitening_query_equals_numpy(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = QUERIES["op12_embedding_whitening"](spark, sf_dir).collect()
    check_against_numpy(rows, [r.vec_id for r in given], [r.embedding for r in given])


def test_odd_rows_are_dropped_and_repeats_count_once(spark):
    r = np.random.default_rng(1)
    good = [(k, r.standard_normal(6).tolist(), 1) for k in range(40)]
    good += [(100, good[0][1], 1), (100, good[0][1], 1), (None, good[3][1], 2), (300, [c + 1e-9 for c in good[7][1]], 1)]
    odd = [
        (200, None, 1), (201, [], 1), (202, [1.0] * 5, 1), (203, [1.0] * 5 + [None], 1),
        (204, [math.nan] * 6, 1), (205, [math.inf] * 6, 1),
    ]
    df = table(spark, good + odd)
    rows = feast.whiten(df, feast.fit(df)).collect()
    kept = [g for g in good if g[0] is not None]
    ids, vectors = [g[0] for g in kept], [g[1] for g in good]
    assert {r[0] for r in rows} == {g[0] for g in good}
    n = whitened_by_numpy(vectors)[0]
    assert {r.n for r in rows} == {n}
    check_against_numpy([r for r in rows if r[0] is not None], ids, [g[1] for g in kept])


def test_fewer_components_than_wanted(spark):
    line = table(spark, [(k, [float(k), 2.0 * k, 0.0], 1) for k in range(10)])
    rows = feast.whiten(line, feast.fit(line)).collect()
    assert {r.component for r in rows} == {1} and len(rows) == 10
    same = table(spark, [(k, [1.0, 2.0], 1) for k in range(3)])
    assert feast.whiten(same, feast.fit(same)).count() == 0


def test_large_numbers_stay_exact(spark):
    rows = [(k, [float(k) * 2**40, 1.0 - k], 1) for k in range(4)]
    df = table(spark, rows)
    got = {r.id: r.deviation for r in feast.whiten(df, feast.fit(df)).filter("component = 1").collect()}
    for k in range(4):
        exact = (4 * k * 2**48 - 6 * 2**48) ** 2 + (4 * 256 * (1 - k) - 256 * (1 + 0 - 1 - 2)) ** 2
        assert got[k] == (exact if exact < 2**63 else None)


@pytest.mark.parametrize("d", [1, 2, 3, 7, 40])
@pytest.mark.parametrize("kind", ["random", "thin", "steep", "equal", "close"])
def test_contour_finds_what_a_full_decomposition_finds(d, kind):
    r = np.random.default_rng(d)
    a = r.standard_normal((d, max(1, d // 3) if kind == "thin" else 3 * d))
    if kind == "steep":
        a *= np.linspace(1, 50, d)[:, None] ** 2
    v = a @ a.T
    if kind == "equal":
        v = 3 * np.eye(d)
    if kind == "close":
        v = np.diag(np.r_[np.full(d // 2, 5.0), np.full(d - d // 2, 5.0 * (1 - 1e-9))])
    values, vectors = feast.components(v, 4)
    true = np.linalg.eigvalsh(v)[::-1][:4]
    true = true[true > d * 1e-15 * np.trace(v)]
    assert values == pytest.approx(true, rel=1e-12)
    assert np.abs(v @ vectors.T - vectors.T * values).max() < 1e-11 * true[0]
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12


@pytest.mark.parametrize("shift", [-1.0, 0.5, 2.0, 2.5, 9.0])
def test_inertia_counts(shift):
    r = np.random.default_rng(2)
    q = np.linalg.qr(r.standard_normal((6, 6)))[0]
    values = np.array([0.0, 1.0, 2.0, 2.0, 3.0, 8.0])
    assert feast.pivots_below(q * values @ q.T, shift) in {(values < shift).sum(), (values <= shift).sum()}
