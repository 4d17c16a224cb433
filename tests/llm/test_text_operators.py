"""Licences, quality counts, language, toxicity: small fixtures, brute force, held-out accuracy."""

import random
import re
import time

import numpy as np
import pytest
from panelwright.llm import langid, licenses, quality, toxicity
from pyspark.sql import functions as F

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base_scan(text):
    words = WORD.findall(ascii_lower(text))
    places = sorted((i, label) for phrase, label in licenses.BASE.items() for n in [len(phrase.split())] for i in range(len(words) - n + 1) if words[i : i + n] == phrase.split())
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


@pytest.mark.parametrize("name", ["license_base", "quality_counts"])
def test_counts_match_sql(spark, sf_dir, name):
    import duckdb
    from panelwright.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(ORACLE_SQL[name])
    assert sorted(map(tuple, QUERIES[name](spark, sf_dir).select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


LICENCE_TEXTS = [
    None, "", "MIT License", "the mit-license. And CC BY cc_by CC/BY 4.0", "xmit license mit licenses", "GNU\tGeneral\n\nPublic   License, Apache License",
    "cc by cc by cc by", "apache   LİCENSE apache license", "gnu general public mit license", "é" * 50 + " cc by é", "a" * 100000 + " mit license",
    "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause\ncode",
]


def test_base_matches_brute_force(spark, sf_dir):
    rows = [(i, t) for i, t in enumerate(LICENCE_TEXTS)]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in sorted(got)] == [base_scan(t) for _, t in rows]
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = {r.doc_id: r for r in licenses.op3_licenses(spark, sf_dir).collect()}
    assert len(found) == len(table)
    for key, text in table:
        r = found[key]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_scan(text)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("MIT", {"mit"}, 1.0),
        ("MIT OR GPL-3.0-or-later", {"mit", "gpl"}, 1.0),
        ("MIT AND GPL-3.0-or-later", {"mit", "gpl"}, 0.2),
        ("GPL-2.0-only WITH Classpath-exception-2.0", {"gpl"}, 0.6),
        ("MIT OR GPL-2.0 AND AGPL-3.0", {"mit", "gpl", "agpl"}, 1.0),
        ("(MIT OR GPL-2.0) AND AGPL-3.0", {"mit", "gpl", "agpl"}, 0.1),
        ("((Apache-2.0))", {"apache"}, 0.9),
        ("LicenseRef-Own", {"licenseref-own"}, licenses.UNKNOWN),
    ],
)
def test_expressions(text, labels, score):
    assert licenses.evaluate(licenses.WORD.findall(text)) == (frozenset(labels), score)


@pytest.mark.parametrize("text", ["", "AND", "MIT OR", "MIT GPL", "(MIT", "MIT)", "()"])
def test_no_expression(text):
    assert licenses.evaluate(licenses.WORD.findall(text)) is None


def test_expression_ends_with_its_line():
    r = licenses.scan(b"SPDX-License-Identifier: MIT OR\nApache-2.0 */ AND GPL")
    assert r.labels == "mit" and r.score == 1.0
    assert licenses.scan(b"SPDX-License-Identifier: GPL-2.0 WITH x) rest").labels == "gpl"


@pytest.mark.parametrize(
    ("line", "labels"),
    [("MIT and more text", "mit"), ("see the file", ""), ("MIT OR (GPL-2.0", "mit"), ("Artistic-2.0 OR Zlib.", "artistic-2.0,zlib"), ("LicenseRef-Own AND mit", "licenseref-own,mit")],
)
def test_prose_after_a_tag_is_no_expression(line, labels):
    assert licenses.scan(f"SPDX-License-Identifier: {line}".encode()).labels == labels


@pytest.mark.parametrize(
    ("line", "labels", "score"),
    [
        ("WTFPL", "wtfpl", licenses.UNKNOWN), ("X11", "x11", licenses.UNKNOWN), ("curl", "curl", licenses.UNKNOWN), ("Beerware */", "beerware", licenses.UNKNOWN),
        ("MIT OR NCSA", "mit,ncsa", 1.0), ("MIT AND Artistic", "artistic,mit", licenses.UNKNOWN), ("NCSA AND (curl OR MIT)", "curl,mit,ncsa", licenses.UNKNOWN),
        ("Artistic AND MIT", "artistic,mit", licenses.UNKNOWN), ("MIT and see the file", "mit", 1.0), ("MIT and NCSA", "mit,ncsa", licenses.UNKNOWN),
        ("GPL-2.0 WITH Own", "gpl", licenses.WITH_LEAST), ("NONE", "", 0.0), ("NOASSERTION", "", 0.0), ("See the file", "", 0.0), ("2024", "", 0.0),
    ],
)
def test_identifiers_of_any_name(line, labels, score):
    r = licenses.scan(f"# SPDX-License-Identifier: {line}\nmore".encode())
    assert (r.labels, r.score) == (labels, score)


def test_long_expressions_take_one_pass():
    deep = b"SPDX-License-Identifier: " + b"(" * 200_000
    wide = b"SPDX-License-Identifier: MIT" + b" OR MIT" * 50_000
    began = time.perf_counter()
    assert licenses.scan(deep).labels == "" and licenses.scan(wide).labels == "mit"
    assert licenses.scan(b"SPDX-License-Identifier: (" * 5_000).labels == ""
    assert time.perf_counter() - began < 10


def test_licences_and_languages_of_empty_tables_and_odd_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.train([("aa", b"aba abba baab " * 5), ("bb", b"xyx yxxy xyyx " * 5)] * 8)
    assert licenses.license_scan(empty).count() == langid.identify(empty, model).count() == 0 and langid.training_sample(empty) == []
    odd = spark.createDataFrame([(None, "mit license abba", 1, "q"), (None, None, 2, "q"), (7, "MIT license", 3, "q"), (7, "mit license", 3, "q")], "doc_id long, text string, n_words int, lang_pred string")
    assert [r.n_base for r in licenses.license_scan(odd).collect()] == [1, 0, 1, 1]
    assert [r.held_out for r in langid.identify(odd, model).collect()][:2] == [False, False]


def brute_counts(text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\\x20\\x09-\\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def quality_texts():
    rng = random.Random(2)
    out = [None, "", " \n\n ", "a b c d e f", "é ñ　x y z q w e r t y u", "# $ % & | < > * a\n# $ % & | < > * a\n\n \n \n# $"]
    for _ in range(40):
        words = [rng.choice(["aa", "bb", "c", "dé"]) for _ in range(rng.randint(1, 60))]
        out.append("".join(w + rng.choice([" ", "\n", "\t ", "\x0b", "\x1c"]) for w in words))
    return out


def test_quality_counts_match_brute_force(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(quality_texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for r in quality.quality(df).collect():
        n, chars, symbols, dup, repeat = brute_counts(rows[r.doc_id][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), rows[r.doc_id]
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
        assert not (r.base_failed and r.kept)


def test_thresholds_follow_the_source(spark):
    """Symbols are common in one source and rare in the other: the same text is kept in the one only."""
    plain = [f"word number{i} in a quiet line of text that has no sign at all" for i in range(300)]
    coded = [f"x{i} * y{i} # z # k | m & n a b c d {'#' * (i % 9)}" for i in range(300)]
    odd = "some # words * with | signs & in # a plain * document of words"
    rows = [(i, t, "en", "prose") for i, t in enumerate(plain)] + [(1000 + i, t, "en", "code") for i, t in enumerate(coded)]
    rows += [(5000, odd, "en", "prose"), (5001, odd, "en", "code"), (5002, plain[0], None, None), (5003, None, None, "prose")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality(df).collect()}
    assert len(kept) == len(rows)
    assert not kept[5000] and kept[5001] and kept[5002] and not kept[5003]
    assert all(kept[i] for i in range(300))
    left = quality.keep_good(df.withColumn("n", F.lit(1)))
    assert left.columns == [*df.columns, "n"] and left.count() == sum(kept.values())


def test_quality_filter_with_clashing_columns(spark):
    rows = [(i, f"one two three four five six seven eight nine ten eleven {i}", "en", "s") for i in range(20)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    wide = df.selectExpr("*", *(f"1 as {c}" for c in ("part", "kept", "good", "docs", "of_id", "n_words", "base_failed")))
    left = quality.keep_good(wide)
    assert left.columns == wide.columns and sorted(r.doc_id for r in left.collect()) == list(range(20))


@pytest.mark.parametrize("others", [0, 150, 199, 200, 400])
def test_quality_judges_a_rare_language(spark, others):
    """Each kind of junk is bad in a language of five rows and in one of none, whatever the size of the rest."""
    plain = "these are quiet words in a line of plain text number {} without signs"
    junk = {
        1: "# words | with & signs * all # over < this > one % and $ more #", 2: "same line of words\n" * 2 + "a b c d e f g h i\n" + "x y\n" * 3,
        3: "SOME LOUD WORDS IN A LINE OF TEXT THAT NEVER STOPS SHOUTING", 4: " ".join(f"averyveryverylongword{i}" for i in range(12)),
        5: "a b c d e f g h i j k l m",
    }
    rows = [(100 + i, plain.format(i), "en", f"s{i % 2}") for i in range(others)]
    rows += [(k + 10 * at, t, lang, "s0") for k, t in junk.items() for at, lang in enumerate(("xx", None))] + [(90, plain.format("x"), "xx", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    assert not any(got[k + at].kept for k in junk for at in (0, 10)) and not any(got[k].base_failed for k in (1, 3, 4, 5))
    assert got[90].kept and all(got[100 + i].kept for i in range(others))


def test_quality_of_an_empty_table(spark):
    assert quality.quality(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_language_is_learnt_and_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    got = langid.op4_langid(spark, sf_dir).join(docs, "doc_id").where("text is not null and lang is not null").collect()
    held = [r for r in got if r.held_out]
    assert held and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.9


def test_language_edge_cases(spark):
    model = langid.train([("aa", b"aba abba baab " * 5), ("bb", b"xyx yxxy xyyx " * 5)] * 8)
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "abba" * 5000), (5, "xyxyyx"), (6, "　€")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 6)] == ["und"] * 4 and [got[i].score for i in (1, 2, 3)] == [0.0] * 3
    assert got[4].lang_pred == "aa" and got[5].lang_pred == "bb"
    untaught = langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), langid.train([]))
    assert {r.lang_pred for r in untaught.collect()} == {"und"}


def test_sampled_texts_are_read_whole(spark, monkeypatch):
    """Long texts are in the sample only where shorter ones are lacking; nothing of a sampled text is cut."""
    monkeypatch.setattr(langid, "SAMPLE_TEXTS", 3)
    monkeypatch.setattr(langid, "LONG_BYTES", 1000)
    rows = [(i, "en", f"text {i} " * (200 if i % 2 else 20)) for i in range(10)] + [(20, "de", "wort " * 900), (21, "de", "kurz"), (22, None, "x"), (23, "fr", ""), (24, "fr", None)]
    texts = {(lang, t) for _, lang, t in rows}
    got = [(lang, raw.decode()) for lang, raw in langid.training_sample(spark.createDataFrame(rows, "doc_id long, lang string, text string"))]
    assert set(got) <= texts and len([1 for lang, _ in got if lang == "en"]) == 3 and all(len(t) < 1000 for lang, t in got if lang == "en")
    assert {t for lang, t in got if lang == "de"} == {"wort " * 900, "kurz"} and not [1 for lang, _ in got if lang in (None, "fr")]


def test_gradient_by_differences():
    """Backpropagation through time against finite differences, in one weight of each kind."""
    rng = np.random.default_rng(0)
    n, steps, rows = langid.UNITS, 5, 3
    w, u = rng.normal(0, 0.3, (257, 2 * n)), rng.normal(0, 0.3, (n, 2 * n))
    x, up = rng.integers(0, 256, (steps, rows)), rng.normal(size=(steps, rows, n)).astype(np.float32)
    for back in (False, True):
        keep = []
        langid._states(w.astype(np.float32), u.astype(np.float32), x, back, keep)
        dw, du = np.zeros_like(w), np.zeros_like(u)
        langid._backward(w, u, x, keep, up, dw, du)
        for a, grad, at in ((w, dw, (x[1, 0], 3)), (w, dw, (x[2, 1], n + 2)), (u, du, (1, 2)), (u, du, (4, n + 5))):
            def loss(step, a=a, at=at, back=back):
                moved = a.copy()
                moved[at] += step
                pair = (moved, u) if a is w else (w, moved)
                return float((langid._states(*(p.astype(np.float32) for p in pair), x, back) * up).sum())

            assert abs((loss(1e-2) - loss(-1e-2)) / 2e-2 - grad[at]) < 5e-3


def test_toxicity_chain(spark):
    rng = random.Random(5)
    calm = ["river", "stone", "cloud", "green", "window", "paper", "music", "bread", "train", "light"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(calm) for _ in range(60)]
        if i % 4 == 0:
            words[rng.randrange(60)] = rng.choice(["Nastyword", "vileness!", "foulthing"])
        if i % 10 == 0:
            words = ["###"] * 10 + words
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 10 != 0), int(i % 4 == 0)))
    rows += [(1000, None), (1001, ""), (1002, "river NASTYWORD stone"), (1003, "river stone " * 20000 + "vileness"), (1004, "stone river")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, toxic string")
    chain = toxicity.fitted(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.toxicity(docs, chain).collect()}
    assert len(got) == len(rows) and all(0 <= r.p_toxic <= 1 and 0 <= r.p_low_quality <= 1 for r in got.values())
    wrong = sum(got[i].toxic != (i % 4 == 0) for i in range(400))
    assert wrong <= 8 and got[1002].toxic and got[1003].toxic
    assert not got[1000].toxic and not got[1001].toxic and not got[1004].toxic
    left = toxicity.keep_clean(docs, chain)
    assert left.columns == docs.columns and left.count() == sum(r.kept for r in got.values())


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    chain = toxicity.fitted(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r.kept for r in toxicity.toxicity(docs, chain).collect()] == [True, True]
    assert toxicity.toxicity(spark.createDataFrame([], "doc_id long, text string"), chain).count() == 0
