"""Repeated strings against counting every string of 200 bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from panelwright.llm import rolling
from panelwright.llm import suffix_dedup as S


def brute(rows, length=S.LENGTH):
    seen = Counter()
    for _, text in rows:
        raw = (text or "").encode()
        seen.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    out = []
    for key, text in rows:
        raw = (text or "").encode()
        spans = S.covered([(k, k + length) for k in range(len(raw) - length + 1) if seen[raw[k : k + length]] > 1])
        kept = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(raw)]))
        out.append((key, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(3)
    rnd = lambda n, of="abcdefgh é": "".join(rng.choice(of) for _ in range(n))
    passages = [rnd(n) for n in (150, 199, 200, 201, 260, 500, 1500)]
    rows = []
    for i in range(120):
        text = ""
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            text += rnd(rng.randint(0, 300)) + rng.choice([p, p[rng.randint(0, 50) : rng.randint(150, 400)]])
        rows.append((i, text + rnd(rng.randint(0, 100))))
    p = passages[6]
    rows += [(200, None), (201, ""), (202, "a" * 3000), (203, "ab" * 900), (204, rows[5][1]), (205, rows[5][1]), (206, "a" * 199)]
    rows += [(207, "a" * 10 + "b" * 205), (208, rnd(2000, "ab") + p), (209, p[:700] + "X" + p[700:]), (210, p[:700] + "Y" + p[700:])]
    rows += [(211, p[:650] + "Z" + p[650:900]), (None, p), (3, "same id, other text " + p[:300]), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize("together", [S.TOGETHER, 1])
def test_matches_brute_force(spark, together):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in S.remaining(df, together).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_registered_query_on_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in S.op1_suffix_array(spark, sf_dir).collect()), key=repr)
    assert got == brute(rows)


def test_sql_of_the_registered_query(spark, sf_dir):
    import duckdb
    from panelwright.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op1_suffix_array"])
    df = S.op1_suffix_array(spark, sf_dir)
    assert df.columns == want.columns
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_sql_of_edge_cases():
    import duckdb
    from panelwright.llm.queries import ORACLE_SQL

    con, rows = duckdb.connect(), corpus()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.sql(ORACLE_SQL["op1_suffix_array"]).fetchall(), key=repr) == brute(rows)


def test_extra_columns_pass_and_empty_texts_go(spark):
    rows = [(1, "x" * 300, "k", 7), (2, "short é", None, 8), (3, None, "z", 9), (4, "", "e", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string, z int")
    got = S.keep_unrepeated(df)
    assert got.columns == df.columns
    assert [tuple(r) for r in got.collect()] == [(2, "short é", None, 8)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.suffix_dedup(df).count() == 0


def test_cut_characters_leave_no_broken_bytes(spark):
    shared = "é" * 150  # 300 bytes; the neighbours below share one byte of theirs
    df = spark.createDataFrame([(1, "à" + shared + "b"), (2, "Ã" + shared + "c")], "doc_id long, text string")
    for r in S.keep_unrepeated(df).collect():
        assert "�" not in r.text


def test_long_texts_go_in_overlapping_parts(monkeypatch):
    monkeypatch.setattr(S, "MOST", 1000)
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 123, 5000, dtype=np.uint8))
    rows = S.segments([text, text[100:2500]])
    covered = Counter()
    for which, at, n, _, _ in rows.tolist():
        covered.update((which, i) for i in range(at, at + n))
    assert set(covered.values()) == {1} and len(covered) == (5000 - 199) + (2400 - 199)


def test_rolling_hashes_depend_on_bytes_only():
    raw = np.frombuffer(b"abcabcabc" * 10, np.uint8)
    h = rolling.Rolling(raw).windows(6)
    assert (h[:3] == h[3:6]).all() and len(set(h[:3].tolist())) == 3
    assert (rolling.least_in_windows(h, 3) == [min(h[i : i + 3]) for i in range(len(h) - 2)]).all()
