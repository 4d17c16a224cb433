"""Near copies of planted edits against all pairs."""

import random
import time

import pytest
from panelwright.llm import near_copies as N


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def planted():
    """Texts of 12 to 900 words with 0 to 12 edits, and a group of many copies that all differ."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for size, copies in [(12, 5), (40, 5), (120, 8), (200, 8), (400, 8), (900, 8)] * 4 + [(150, 120)]:
        base = [word() for _ in range(size)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, min(12, size // 30))):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], [word()], [words[at], word()]])
            rows.append((len(rows) + 1, " ".join(words)))
    return rows + [(9001, None), (9002, " \n"), (9003, "One two"), (9004, "one  TWO"), (9005, "one two three")]


def test_no_near_copies_stay(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = [r.doc_id for r in N.one_of_each(df).collect()]
    assert len(kept) == len(set(kept))
    sets = {i: shingles(t) for i, t in rows}
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = {(i, j) for i in ids for j in ids if i < j and similar(sets[i], sets[j])}
    for i, j in pairs:
        parent[max(find(i), find(j))] = min(find(i), find(j))
    assert not pairs & {(i, j) for i in kept for j in kept}
    assert {find(i) for i in ids} <= set(kept)  # the smallest of a group is never lost
    assert len(pairs) > 1000 and len(kept) < len(rows) / 2


def test_pipeline_stage_drops_light_edits(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    words = [f"w{i}" for i in range(200)]
    edited = [" ".join(words[:at] + ["other"] + words[at + 1 :]) for at in range(20, 190, 10)]
    rows = [(i + 2, t, "en", "s", 1) for i, t in enumerate([" ".join(words), " ".join(words) + " more", *edited])]
    rows += [(1000, " ".join(words[100:] + words[:30]), "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, df, sf_dir)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 1000]


def test_empty_table(spark):
    assert N.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pipeline_stage_drops_copies_with_three_edits(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = []
    for k in range(10):
        words = [f"w{k}x{i}" for i in range(200)]
        edited = [f"new{i}" if i in (40, 90, 150) else w for i, w in enumerate(words)]
        rows += [(k, " ".join(words), "en", "s", 1), (k + 100, " ".join(edited), "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, sf_dir).collect()) == list(range(10))


def test_repeated_and_missing_ids(spark):
    """Different texts of one id stay, equal rows are one, and rows without an id join their groups."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "k"), (1, b, "k"), (1, a, "k"), (2, a + " more", "k"), (None, b, "k"), (None, c, "k"), (None, c, "k"), (None, None, "k"), (3, "", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = N.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, a, "k"), (1, b, "k"), (None, c, "k"), (3, "", "k")], key=str)


def test_prefixes_lose_no_pair(spark):
    """Sets with all similarities around the least one, against all pairs."""
    rng = random.Random(9)
    rows = []
    for _ in range(60):
        base = rng.sample(range(10**6), rng.randint(1, 60))
        for _ in range(6):
            some = [x for x in base if rng.random() > 0.08] + rng.sample(range(10**6), rng.randint(0, max(1, len(base) // 12)))
            rows.append((len(rows), sorted(set(some or base))))
    df = spark.createDataFrame(rows, "same long, shingles array<long>")
    got = {tuple(sorted(r)) for r in N.prefix_pairs(df).collect()}
    sets = [set(s) for _, s in rows]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if similar(sets[i], sets[j])}
    assert len(want) > 200 and want <= got


def test_word_hashes_follow_words_only():
    """Place, white space and the parts a long text is hashed in don't matter; words beyond a buffer are words, too."""
    long = b"x" * (N.MOST + 7)
    words = [b"a", b"bb", long, b"\xc3\xa9", b"\xff\x00", b"w" * (N.MOST - 1), *(b"k%d" % (i % 50000) for i in range(90000)), long, b"a"]
    alone = {w: N.word_hashes(w) for w in set(words)}
    assert all(len(h) == 1 for h in alone.values()) and len({int(h[0]) for h in alone.values()}) == len(alone)
    for space in (b" ", b"\n\t", b" \r\x0b\x0c"):
        found = N.word_hashes(space + space.join(words) + space)
        assert found.tolist() == [int(alone[w][0]) for w in words]
    assert not len(N.word_hashes(b"")) and not len(N.word_hashes(b" \n"))


def test_shingle_sets_match_tuples():
    rng = random.Random(8)
    for size in (0, 1, 3, 4, 5, 6, 40, 700):
        text = " ".join(rng.choice("aBcD") for _ in range(size))
        assert len(N.shingle_set(text.encode())) == len(shingles(text))
    assert N.shingle_set(b"One  two").tolist() == N.shingle_set(b"one\ttwo").tolist() != N.shingle_set(b"two one").tolist()
    assert not len(N.shingle_set(None))


@pytest.mark.parametrize("seed", [1, 2])
def test_links_of_chains_and_dropped_texts_are_found(spark, seed):
    """Groups of texts with more and more edits, so that many resemble only some of their group: nearly all links lie within one group."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(8):
        words = [rng.choice(vocabulary) for _ in range(90)]
        for _ in range(20):
            words = list(words)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    sets = [frozenset(N.shingle_set(t.encode()).tolist()) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] != sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    keyed = df.select(N.row_key().alias("doc_id"), df.doc_id.alias("id"), "text")
    prints = N.stored(N.described(keyed, "bands", N.band_keys, ("id",)), "prints")
    group = {r.node: r.component for r in N.connected_components(N.near_copies(keyed.select("doc_id", "text"), prints)).collect()}
    name = {r.id: r.same for r in prints.collect()}
    kept = sum(group.get(name[i], name[i]) == group.get(name[j], name[j]) for i, j in links)
    assert len(links) > 100 and kept >= 0.99 * len(links)


def linked(spark, texts):
    """Pairs of texts that are near copies, and the group that each text is given."""
    sets = [frozenset(N.shingle_set(t.encode()).tolist()) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] != sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = df.select(N.row_key().alias("doc_id"), df.doc_id.alias("id"), "text")
    prints = N.stored(N.described(keyed, "bands", N.band_keys, ("id",)), "prints")
    group = {r.node: r.component for r in N.connected_components(N.near_copies(keyed.select("doc_id", "text"), prints)).collect()}
    return links, {r.id: group.get(r.same, r.same) for r in prints.collect()}


def test_every_link_is_within_a_group(spark):
    """Large families in which a text resembles only the few that were made next to it, so that dropped ones hold chains together."""
    rng = random.Random(31)
    texts = []
    for f in range(4):
        words = [f"f{f}w{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(60):
            words = list(words)
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    links, group = linked(spark, texts)
    assert len(links) > 200 and not [(i, j) for i, j in links if group[i] != group[j]]


def test_prefixes_between_groups_lose_no_pair(spark):
    rng = random.Random(10)
    rows = []
    for _ in range(40):
        base = rng.sample(range(10**6), rng.randint(1, 60))
        for _ in range(8):
            some = [x for x in base if rng.random() > 0.06] + rng.sample(range(10**6), rng.randint(0, max(1, len(base) // 15)))
            rows.append((len(rows), rng.randrange(5), sorted(set(some or base))))
    found = [tuple(sorted(r)) for r in N.prefix_pairs(spark.createDataFrame(rows, "same long, group long, shingles array<long>")).distinct().collect()]
    sets, groups = [set(s) for *_, s in rows], [g for _, g, _ in rows]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if groups[i] != groups[j] and similar(sets[i], sets[j])}
    assert len(want) > 200 and want <= set(found) and all(groups[i] != groups[j] for i, j in found)


def test_fingerprint_cells_are_components(spark):
    """Random fingerprints and changes of a few bits, against all pairs."""
    rng = random.Random(12)
    prints = []
    for _ in range(60):
        fp = rng.getrandbits(64)
        for _ in range(5):
            for _ in range(rng.choice([0, 1, 5, 6])):
                fp ^= 1 << rng.randrange(64)
            prints.append(fp)
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= N.RADIUS:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    roots = [find(i) for i in range(len(prints))]
    df = spark.createDataFrame([(i, 1, fp - (1 << 64) if fp >> 63 else fp) for i, fp in enumerate(prints)], "same long, n long, fp long")
    got = {r.same: r.cell for r in N.fingerprint_cells(df).collect()}
    assert got == {i: r for i, r in enumerate(roots) if roots.count(r) > 1} and len(got) < len(prints)


def test_pipeline_stage_takes_candidates_from_fingerprints(spark, sf_dir, monkeypatch):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from panelwright.llm import simhash

    radii, links = [], simhash.print_links
    monkeypatch.setattr(simhash, "print_links", lambda nodes, grid, max_bits: radii.append(max_bits) or links(nodes, grid, max_bits))
    monkeypatch.setattr(N, "band_keys", lambda shingles: pytest.fail("minimum hashes"))
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words), "en", "s", 1), (2, " ".join([*words, "more"]), "en", "s", 1), (3, " ".join(words[::-1]), "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, sf_dir).collect()) == [1, 3]
    assert radii == [N.RADIUS]


@pytest.mark.parametrize("common", [[], list(range(0, 4000, 3)), list(range(4000))])
def test_marks_of_near_sets_meet(common):
    """Whichever shingles are called common, prefixes of near copies share their first common shingle, where it counts."""
    rng = random.Random(13)
    describe = N.marks(N.np.array(common, N.np.uint64))
    for _ in range(300):
        base = rng.sample(range(4000), rng.randint(1, 60))
        a, b = (sorted(set([x for x in base if rng.random() > 0.05] + rng.sample(range(4000), rng.randint(0, 3)))) for _ in "ab")
        firsts = [describe(N.np.array(s, N.np.uint64))[1:].tolist() for s in (a, b)]
        assert all(len(f) == len(set(f)) and set(f) <= set(s) for f, s in zip(firsts, (a, b)))
        if a and b and similar(set(a), set(b)):
            assert set(firsts[0]) & set(firsts[1])


def test_pairs_with_few_common_prefix_shingles_do_not_come_out(spark):
    """A pair may share the first shingle of its prefixes and still too few others of them; such pairs would all be compared whole."""
    one = list(range(100))
    rows = [(1, 1, one), (2, 2, [0, *range(200, 299)]), (3, 3, [*range(1, 96), *range(300, 305)])]
    firsts = [(same, group, 100, at, x) for same, group, s in rows for at, x in enumerate(s[:21])]
    df = spark.createDataFrame(firsts, "same long, group long, n long, at int, shingle long")
    assert [tuple(sorted(r)) for r in N.meeting(df).collect()] == [(1, 3)]


def test_filter_loses_no_row_and_keeps_few_others(spark):
    df = spark.range(20_000).select(N.F.unhex(N.F.md5(N.F.col("id").cast("string"))).alias("doc_id"), "id")
    rows = df.where("id % 100 = 7").select("doc_id")
    bits, held = N.perhaps_among(rows, "doc_id")
    kept, rest = ({r.id for r in df.join(bits, held, how).collect()} for how in ("left_semi", "left_anti"))
    assert set(range(7, 20_000, 100)) <= kept and len(kept) < 220
    assert not kept & rest and len(kept) + len(rest) == 20_000
    empty = N.perhaps_among(rows.where("doc_id is null"), "doc_id")
    assert df.join(*empty, "left_anti").count() == 20_000 and df.join(*empty, "left_semi").count() == 0


def test_few_texts_go_to_a_join(spark, tmp_path):
    """All but the rows that may have to go stay where they are: the last step shuffles no text of theirs."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(5)] + [rows[7]] * 3
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    got = N.one_of_each(spark.read.parquet(f"{tmp_path}/docs"))
    assert sorted(r.doc_id for r in got.collect()) == list(range(400))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "Union" in plan


def join_rows(spark, since):
    """The most rows that a join has made in a query after the first ``since`` ones."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    queries = store.executionsList(since, 1000)
    for q in (queries.apply(i).executionId() for i in range(queries.size())):
        values, nodes = store.executionMetrics(q), store.planGraph(q).allNodes()
        for metrics in (nodes.apply(j).metrics() for j in range(nodes.size()) if "Join" in nodes.apply(j).name()):
            for m in (metrics.apply(k) for k in range(metrics.size())):
                if m.name() == "number of output rows" and (value := values.get(m.accumulatorId())).isDefined():
                    most = max(most, int(value.get().replace(",", "")))
    return most


def test_texts_that_share_much_but_too_little_do_not_meet(spark):
    """Sets of one origin, each with a fifth of its own: all pairs share most of their prefixes' later shingles, none are near copies."""
    rng = random.Random(14)
    base = list(range(100))
    firsts = []
    for i in range(120):
        own = [1000 * (i + 1) + k for k in range(14)]
        left = sorted(rng.sample(base, 86))
        firsts += [(i, i, 100, at, x) for at, x in enumerate((own + left)[:21])]
    df = spark.createDataFrame(firsts, "same long, group long, n long, at int, shingle long")
    before = spark._jsparkSession.sharedState().statusStore().executionsCount()
    assert not N.meeting(df).collect()
    time.sleep(1)  # figures of a query come in a little later
    assert 0 < join_rows(spark, before) <= len(firsts)


def test_sketches_lose_no_near_copy():
    rng = random.Random(15)
    bits = lambda s: N.np.unpackbits(N.sketch(N.np.array(sorted(s), N.np.uint64)).view(N.np.uint8))
    for size in (1, 40, 700):
        a = {rng.getrandbits(64) for _ in range(size)}
        for gone in (0, size // 20, size // 3):
            b = set(sorted(a)[gone:]) | {rng.getrandbits(64) for _ in range(gone)}
            assert (bits(a) != bits(b)).sum() <= len(a ^ b)
