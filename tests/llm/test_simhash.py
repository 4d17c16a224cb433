"""Fingerprints against their definition, components against all pairs."""

import random

import pytest
import xxhash
from panelwright.llm import simhash as S
from panelwright.llm.common import connected_components
from pyspark.sql import functions as F


def fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows):
    prints = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, f"{p:016x}", least[find(i)]) for i, ((k, _), p) in enumerate(zip(rows, prints)))


def texts():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([80, 300, 700]))]
        for _ in range(6):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 + 5, " ".join(words)))
    return rows + [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (900, "ONE two"), (901, "one\ttwo"), (902, "a b c d"), (903, "É Ö x y z"), (904, "é ö x y z"), (905, "nb sp 　 q r s t")]


def test_matches_all_pairs(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in S.near_duplicates(df).collect()) == expected(rows)


def test_registered_query_on_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in S.op9_simhash(spark, sf_dir).collect()) == expected(rows)


def test_chains_and_the_bound(spark):
    """Links of up to four bits chain to one component; five bits don't link; signs don't matter."""
    prints = [0, 0b1111, 0b11111111, 0b1111111111111, -1, -1 << 4, 1 << 62, -(1 << 63)]
    rows = [(i + 10, p) for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    unsigned = [p % (1 << 64) for p in prints]
    want = {(a + 10, b + 10) for a in range(8) for b in range(a + 1, 8) if (unsigned[a] ^ unsigned[b]).bit_count() <= 4}
    found = S.links(df).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_empty_table_and_extra_columns(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b c d e", 5, "x"), (1, "a b c d e", 5, "x")], "doc_id long, text string, fp int, component_id string")
    assert [r.component_id for r in S.near_duplicates(df).collect()] == [1, 1]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40, 0, -1)] + [(100, k) for k in range(101, 160)] + [(7, 7), (500, 501), (501, 500)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 1 for k in range(1, 42)) and all(got[k] == 100 for k in range(100, 160)) and got[501] == 500


def test_null_and_shared_ids(spark):
    """Rows without an id link others and have their component's smallest id, if there is one; a shared id joins nothing by itself."""
    prints = [(None, 0b0), (None, 0b0), (None, 0b1111), (7, 0b11111111), (9, 0b11111111), (None, 1 << 40 | 0xFFFFFF << 8), (5, 0x5555555555555555), (5, -1), (3, -2), (None, 0x3333333333333333)]
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in S.components(spark.createDataFrame(prints, "doc_id long, fp long")).collect()), key=repr)
    want = {0b0: 7, 0b1111: 7, 0b11111111: 7, 1 << 40 | 0xFFFFFF << 8: None, 0x5555555555555555: 5, -1: 3, -2: 3, 0x3333333333333333: None}
    assert got == sorted(((i, p, want[p]) for i, p in prints), key=repr)
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (4, "z y x w v u"), (4, "other words in here")], "doc_id long, text string")
    rows = S.near_duplicates(docs).collect()
    assert len(rows) == 4 and [r.component_id for r in rows if r.doc_id is None] == [None, None] and {r.component_id for r in rows if r.doc_id} == {4}


@pytest.mark.parametrize("grid", [S.Grid(2, 6), S.Grid(2, 8), S.Grid(2, 10), S.Grid(1, 6), S.Grid(1, 7), S.Grid(1, 10)])
def test_any_grid_finds_the_same_pairs(spark, grid):
    rng = random.Random(grid.groups)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(7))) for b in base for _ in range(12)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 4}
    found = [tuple(r) for r in S.print_links(nodes, grid).collect()]
    assert set(found) == want and len(found) == len(want) and want


def test_embedding_and_its_distance(spark):
    """Bit counts of segments, and a distance that is that of the counts and never above that of the fingerprints."""
    rng = random.Random(3)
    pairs = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(300)] + [(0, (1 << 64) - 1), (1 << 63, 1 << 62)]
    pairs += [(a, a ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)) for a, _ in pairs]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(i, signed(a), signed(b)) for i, (a, b) in enumerate(pairs)], "i int, a long, b long")
    for width in S.EQUAL:
        ea, eb = (S.embedded(F.col(c), width) for c in "ab")
        counts = lambda v: [(v >> k & (1 << width) - 1).bit_count() for k in range(0, 64, width)]  # noqa: B023, E731
        for r in df.select("i", ea.alias("ea"), S.manhattan(ea, eb, width).alias("d")).collect():
            a, b = pairs[r.i]
            unpacked = [r.ea % (1 << 64) >> k & (1 << width) - 1 for k in range(0, 64, width)]
            assert unpacked == counts(a)
            assert r.d == sum(abs(x - y) for x, y in zip(counts(a), counts(b))) <= (a ^ b).bit_count()


def test_candidates_do_not_grow_with_the_table():
    """Chance candidates of a fingerprint, by the cells it shares with others, at any number of rows."""
    chosen = [S.grid_for(n) for n in (10**3, 10**5, 10**6, 10**7, 10**9, 10**10)]
    for n, grid in zip((10**3, 10**5, 10**6, 10**7, 10**9), chosen):
        alike = S.EQUAL[grid.width] ** (64 / grid.width * (grid.groups - 4) / grid.groups)
        assert n * len(S.cell_masks(grid)) * alike <= S.CHANCE
    assert chosen[0].width == 2 and chosen[-1].width == 1 and [c.width for c in chosen] == sorted((c.width for c in chosen), reverse=True)
    with pytest.raises(ValueError):
        S.grid_for(10, 9)


def test_measured_candidates_of_two_sizes(spark):
    """Pairs that share a cell, of random fingerprints: about as many a fingerprint in the larger table."""
    shared = {}
    for n in (2000, 16000):
        grid = S.grid_for(n)
        nodes = spark.range(n).select(F.xxhash64("id").alias("fp"))
        masks = S.cell_masks(grid)
        cells = nodes.select(F.posexplode(F.array(*[S.embedded(F.col("fp"), grid.width).bitwiseAND(F.lit(m)) for m in masks])).alias("k", "cell"))
        shared[n] = cells.groupBy("k", "cell").count().agg(F.sum(F.expr("count * (count - 1)"))).first()[0] / n
    assert all(v <= 1.5 * S.CHANCE for v in shared.values())


def test_cells_are_never_broadcast(spark):
    """A node makes dozens of cells, which Spark takes to be as small as the nodes' file: broadcast, they would fill the driver."""
    nodes = S.stored(spark.range(100).select(F.xxhash64("id").alias("fp")), "nodes")
    plan = S.print_links(nodes, S.Grid(1, 8))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
