"""Operators on embeddings against brute force in Python's own numbers, and against DuckDB."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from panelwright.llm import centroids as C
from panelwright.llm import topk as T
from panelwright.llm import whitening as W
from panelwright.llm.queries import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>"
BAD = [(5, None), (6, [1.0, None, 2.0]), (7, [1.0, math.nan, 0.0]), (8, [math.inf, 0.0, 0.0])]


def vectors(n, dims, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return [[float(np.float32(v)) for v in row] for row in rng.standard_normal((n, dims)) * spread]


def best(rows, k, scale=64, every=20):
    ints = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for q, (qid, qv) in enumerate(ints):
        if qid is None or qid % every:
            continue
        all_ = [(-max(min(sum(a * b for a, b in zip(qv, v)), T.LIMIT), -T.LIMIT), i is None, i or 0) for c, (i, v) in enumerate(ints) if c != q]
        found += [(qid, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(all_)[:k])]
    return sorted(found, key=repr)


def run_topk(spark, rows, schema=SCHEMA, **more):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return sorted(map(tuple, T.top_k(df, F.col("vec_id") % 20 == 0, **more).collect()), key=repr)


@pytest.mark.parametrize("spread", [0.05, 1.0, 3e4, 1e9])
def test_topk_matches_brute_force(spark, spread):
    """Small spreads have many ties; large ones need wider numbers, more passes, and saturate."""
    rows = list(enumerate(vectors(300, 5, 1, spread))) + BAD
    assert run_topk(spark, rows, k=7, cell=64) == best(rows, 7)


def test_topk_ties_copies_and_odd_ids(spark):
    copies = [(i, [0.5, -0.25, 1.0]) for i in range(0, 400, 2)]
    rows = copies + [(None, [0.5, -0.25, 1.0]), (None, [9.0, 9.0, 9.0]), (40, [3.0, 1.0, 1.0]), (40, [0.5, -0.25, 1.0]), (-20, [0.0, 0.0, 0.0]), (3, [1.0]), (9, [])] + BAD
    random.Random(3).shuffle(rows)
    assert run_topk(spark, rows, k=20, cell=50) == best(rows, 20)
    # the other row of an id is no less a candidate than any other
    twice = [(20, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [1.0, 1.0])]
    assert run_topk(spark, twice) == best(twice, 20)


def test_topk_of_few_or_no_rows(spark):
    assert run_topk(spark, []) == [] and run_topk(spark, BAD) == [] and run_topk(spark, [(20, [1.0])]) == []
    assert run_topk(spark, [(1, [1.0]), (2, [2.0])]) == []
    few = [(20, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [0.0, -4.0])]
    assert run_topk(spark, few) == best(few, 20)
    wide = [(i, v, "x", 1, 2.0, True) for i, v in few]
    assert run_topk(spark, wide, f"{SCHEMA}, query string, row int, score double, candidate boolean") == best(few, 20)


def test_products_are_exact_at_every_width():
    rng = np.random.default_rng(4)
    for size in (10, 1000, 10**6, 10**9, 10**15):
        q, c = (np.floor(rng.standard_normal((6, 9)) * size) for _ in range(2))
        want = [[max(min(sum(int(a) * int(b) for a, b in zip(x, y)), T.LIMIT), -T.LIMIT) for y in c] for x in q]
        assert T.products(q, c, *(float(np.sqrt((m * m).sum(1)).max()) for m in (q, c))).tolist() == want


@pytest.mark.parametrize("name", ["op11_topk", "op13_centroids"])
def test_registered_queries_match_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, sf_dir).select(*want.columns).collect()
    assert len(got) and sorted(map(tuple, got)) == sorted(want.fetchall())


def expected_whitening(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max(len(v) for _, v in kept)
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (dims - len(v)) for _, v in kept])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = (n * fit - sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for row, (i, _) in zip(x, kept):
        d = n * row.astype(object) - sums.astype(object)
        w = (d.astype(float) / n) @ axes / np.sqrt(np.abs(values))
        out.setdefault(i, []).append((n, int((d * d).sum()), w))
    return out, values


def check_whitening(spark, rows, components=16):
    got = W.whitened(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want, values = expected_whitening(rows)
    components = min(components, int((values > W.RANK * values[0]).sum()))
    assert len(got) == components * sum(map(len, want.values()))
    signs = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        k = r.component - 1
        near = [w for w in want[r.vec_id] if (r.n, r.deviation) == w[:2] and abs(abs(w[2][k]) - abs(r.whitened)) < 1e-7]
        assert near and math.isclose(r.explained, values[k] / values.sum(), rel_tol=1e-9) and r.identity_error < 1e-9
        if abs(r.whitened) > 1e-3 and len(near) == 1:
            assert signs.setdefault(k, near[0][2][k] * r.whitened > 0) == (near[0][2][k] * r.whitened > 0)
    return got


def test_whitening_matches_a_dense_solver(spark):
    base = np.array(vectors(300, 24, 5)) * np.linspace(3, 0.2, 24)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    copies = [(1000 + i, rows[3][1]) for i in range(200)] + [(None, rows[4][1]), (7, rows[9][1])]
    check_whitening(spark, rows + copies + [(i + 2000, v) for i, v in BAD[:1]])


def test_whitening_of_low_rank_and_few_rows(spark):
    plane = [(i, [a, b, a + b, a - b]) for i, (a, b) in enumerate(vectors(60, 2, 6)) for a, b in [(round(a * 8) / 8, round(b * 8) / 8)]]
    got = check_whitening(spark, plane)
    assert {r.component for r in got} == {1, 2}
    assert W.whitened(spark.createDataFrame([], SCHEMA)).count() == 0
    assert W.whitened(spark.createDataFrame(BAD, SCHEMA)).count() == 0
    assert W.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).count() == 0
    assert W.whitened(spark.createDataFrame([(1, [])], SCHEMA)).count() == 0
    extra = spark.createDataFrame([(1, [1.0, 2.0], 5, "x"), (2, [2.0], 5, "x")], f"{SCHEMA}, n int, component string")
    assert {(r.vec_id, r.component, r.n) for r in W.whitened(extra).collect()} == {(1, 1, 2), (2, 1, 2)}


def test_whitening_of_the_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, values = expected_whitening(rows)
    got = W.op12_whitening(spark, sf_dir).collect()
    assert len(got) == 16 * len(rows) and max(r.identity_error for r in got) < 1e-9
    assert all(abs(abs(want[r.vec_id][0][2][r.component - 1]) - abs(r.whitened)) < 1e-8 and want[r.vec_id][0][1] == r.deviation for r in got)


def test_deviations_beyond_longs():
    x = np.array([[3 << 40, -5], [1 << 52, 7]])
    found = W.differences(x, 10**6, [12345, 678])
    assert [[int(v) for v in r] for r in found] == [[(3 << 40) * 10**6 - 12345, -5 * 10**6 - 678], [(1 << 52) * 10**6 - 12345, 7 * 10**6 - 678]]
    small = W.differences(np.array([[1, 2]]), 3, [4, 5])
    assert small.dtype == np.int64 and small.tolist() == [[-1, 1]]


@pytest.mark.parametrize("dims,basis", [(40, 256), (90, 40), (12, 256)])
def test_lanczos_with_restarts_and_breakdowns(dims, basis):
    """Eigenvalues of several multiplicities; a map of low rank breaks blocks down at once; a small basis is restarted."""
    rng = np.random.default_rng(8)
    turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    for values in (np.geomspace(50, 0.001, dims), np.where(np.arange(dims) < 5, 3.0, 0.0), np.repeat([4.0, 2.0, 1.0, 0.5], -(-dims // 4))[:dims]):
        v = (turn * values) @ turn.T
        passes = []
        found, axes = W.leading_pairs(lambda b: passes.append(1) or v @ b, dims, 6, block=4, basis_size=basis)
        assert np.allclose(found, np.sort(values)[::-1][:6], atol=1e-11)
        assert np.abs(v @ axes - axes * found).max() < 1e-11 and np.abs(axes.T @ axes - np.eye(6)).max() < 1e-12


def expected_clusters(rows, count, rounds=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"2:{i}".encode()).hexdigest())
    at = [v for _, v in sorted(kept, key=lambda p: (digest(p[0]), p[1]))[:count]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(at))
    for turn in range(rounds + 1):
        found = [near(v) for _, v in kept]
        if turn == rounds:
            break
        for k in range(len(at)):
            mine = [v for (_, v), (_, c) in zip(kept, found) if c == k]
            if mine:
                at[k] = [sum(col) // len(mine) for col in zip(*mine)]
    total = {k: sum(d for d, c in found if c == k) for k in range(len(at))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted([(i, c, d, total[c], sum(total.values()), sha[c]) for (i, _), (d, c) in zip(kept, found)], key=repr)


def run_clusters(spark, rows, schema=SCHEMA, **more):
    return sorted(map(tuple, C.clusters(spark.createDataFrame(rows, schema).repartition(3), **more).collect()), key=repr)


def test_clusters_match_brute_force(spark):
    rows = list(enumerate(vectors(200, 64, 9, 0.1))) + BAD
    rows += [(300 + i, rows[0][1]) for i in range(90)] + [(None, rows[1][1]), (None, rows[2][1]), (4, rows[3][1]), (900, [1.0] * 63), (901, [1.0] * 65)]
    random.Random(1).shuffle(rows)
    assert run_clusters(spark, rows, count=9) == expected_clusters(rows, 9)


def test_clusters_of_few_rows_and_ties(spark):
    assert run_clusters(spark, []) == [] and run_clusters(spark, BAD) == []
    one = [(i, [0.5] * 64) for i in range(5)] + [(None, [-0.5] * 64)]
    assert run_clusters(spark, one) == expected_clusters(one, 40)
    big = [(i, [float(s * 5e5)] * 63 + [float(i)]) for i, s in enumerate((1, -1, 1, -1, 0))]
    assert run_clusters(spark, big, count=2) == expected_clusters(big, 2)
    wide = [(i, v, 1, "x", 2) for i, v in one]
    assert run_clusters(spark, wide, f"{SCHEMA}, cluster int, vec string, inertia long") == expected_clusters(one, 40)


def test_screening_never_hides_the_nearest():
    """Whole-numbered points halfway between centroids, near and far from zero: every exact distance lies in its interval."""
    rng = np.random.default_rng(2)
    for size in (3, 300, 30000, 1 << 25):
        at = np.floor(rng.standard_normal((12, 64)) * size)
        x = np.floor((at[rng.integers(0, 12, 400)] + at[rng.integers(0, 12, 400)]) / 2)
        low, high = C.intervals(x, at)
        exact = ((x[:, None].astype(np.int64) - at[None].astype(np.int64)) ** 2).sum(2)
        assert (low <= exact).all() and (exact <= high).all()
        number, distance = C.nearest(x, at)
        assert (number == exact.argmin(1)).all() and (distance == exact.min(1)).all()
