"""Tokens, media, pages, packing and the pipeline."""

import hashlib
import random
import tarfile
import time
import zlib
from collections import Counter

import pytest
from panelwright.llm import bpe, html_text, media, packing
from panelwright.llm.common import work_dir
from pyspark.sql import functions as F

TEXTS = [
    None, "", " ", "a", "  a b", "foo <|endoftext|> bar", "x<|endoftext|>\n\n  y", "\t\ta  \n b" * 300, "don't we'll  　 a b" * 200,
    "a\x1cb " * 800, "é" * 3000, "  " * 2000, "\n\n\nab c" * 900, "<|endoftext|>" * 300, "日本語 テスト。 " * 400, "x" * 20000, "👩‍👩‍👧 " * 500,
    "the same passage of some length, over and over. " * 120, "prefix " + "the same passage of some length, over and over. " * 120,
]


def library(text):
    tok = bpe.tokenizer(bpe.default_vocabulary())
    ids = tok.encode(text or "", add_special_tokens=False).ids
    decoded = tok.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_tokens_match_the_library(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(df).collect()}
    assert got == {i: library(t) for i, t in enumerate(TEXTS)}


def test_registered_tokens_on_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op10_bpe(spark, sf_dir).collect()}
    assert got == {i: library(t) for i, t in rows}


def test_ids_and_text_come_back(spark):
    df = spark.createDataFrame([(1, "some text é", 5)], "doc_id long, text string, key long")
    r = bpe.encode(df, with_ids=True).first()
    assert r.decoded == "some text é" and len(r.ids) == r.n_tokens
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chunks_are_encoded_once_and_forgotten_in_bounds(monkeypatch):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 9))) for _ in range(4000)).encode()
    coder = bpe.Coder(bpe.default_vocabulary())
    coder.code(text)
    first = coder.encoded
    coder.code(text)
    coder.code(b"other start " + text)
    assert coder.encoded - first < 0.1 * first  # all but the moved start is known
    monkeypatch.setattr(bpe, "HELD", 1000)
    again = coder.code(text)
    assert again == bpe.Coder(bpe.default_vocabulary()).code(text)


@pytest.mark.parametrize("edge", [None, rb"(?<=[\x00-\x7f])(?=[\x00-\x7f])"])
def test_joins_agree_with_the_whole_text(monkeypatch, edge):
    """Tiny chunks, so that joins are everywhere; also with word ends where none are, so that joins disagree."""
    monkeypatch.setattr(bpe, "LEAST_CHUNK", 24)
    monkeypatch.setattr(bpe, "MASK", bpe.np.uint64(7))
    if edge:
        monkeypatch.setattr(bpe, "EDGE", bpe.re.compile(edge))
    coder = bpe.Coder(bpe.default_vocabulary())
    for text in filter(None, TEXTS):
        text = text[:4000]
        got = coder.code(text.encode())
        assert (got.n, got.decimals[:-1]) == (len(ids := coder.tok.encode(text, add_special_tokens=False).ids), ",".join(map(str, ids)))
        assert got.decoded.decode() == coder.tok.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("ids", ["distinct", "null", "one"])
def test_copies_of_a_heavy_key_are_spread(spark, ids):
    """Whatever their ids are: 2,000 copies of one text go to tasks of a few hundred each, and come out once each."""
    text = "the same words again and again, " * 4
    rows = [({"distinct": i, "null": None, "one": 7}[ids], text) for i in range(2000)] + [(5000 + i, f"some other text, number {i} of them all") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        routed = bpe.route(df, task_bytes=2000)
        sizes = [r["count"] for r in routed.where(routed.text == text).groupBy(F.spark_partition_id()).count().collect()]
        again = sorted(routed.collect(), key=repr)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 2000 and len(sizes) == 16 and max(sizes) < 300
    assert [tuple(r) for r in again] == sorted(((i, t) for i, t in rows), key=repr)


def test_bytes_that_are_not_utf8(spark):
    df = spark.sql("select 1L doc_id, cast(X'61FF62' as string) text")
    assert bpe.encode(df).first().ids_sha256 == library("a\ufffdb")[1]


def test_cuts_are_content_defined():
    rng = random.Random(4)
    body = bytes(rng.choice(b"abcdefgh ") for _ in range(20000))
    a, b = bpe.cuts(body), [c - 777 for c in bpe.cuts(b"z" * 777 + body)]
    assert len(set(a) & set(b)) >= len(a) - 3 and a[-1] == len(body)
    assert bpe.cuts(b"") == [0]


def test_media_round_trip(spark):
    texts = [None, "", "a", "é" * 100, "x" * 64, "x" * 64, "y" * 65, "long " * 20000, "a\0", "a"]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media_sha256 string").repartition(3)
    got = {r.doc_id: r for r in media.media_columns(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        image = media.to_png(payload)
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), media.feature(payload))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) == want
        assert (r.width, r.height) == (64, len(payload) // 64)
    assert got[2].media_sha256 == got[9].media_sha256 and got[0].feature == got[1].feature


def test_shards_are_tar_files_with_one_copy_each(spark):
    folder = work_dir(spark, "media-test")
    df = spark.createDataFrame([(i, f"text {i % 5}") for i in range(40)], "doc_id long, text string").coalesce(1)
    places = media.write_media(df, folder)
    assert places.count() == 40
    for (shard,) in places.select("shard").distinct().collect():
        with tarfile.open(f"{folder.removeprefix('file://')}/{shard}") as tar:
            members = tar.getmembers()
            assert len(members) == 5
            for m in members:
                assert hashlib.sha256(media.from_png(tar.extractfile(m).read())).hexdigest() + ".png" == m.name
    assert media.places_of(places).count() == 5
    assert {(r.width, r.depth) for r in media.media_headers(media.places_of(places), folder).collect()} == {(64, 8)}


def test_media_of_repeated_and_missing_ids(spark, monkeypatch):
    """Ids don't matter, nor does how often a shard is closed: a task keeps a bounded number of rows."""
    monkeypatch.setattr(media, "SHARD_ROWS", 40)
    rows = [(None, "same")] * 100 + [(3, "same")] * 30 + [(3, f"own {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("feature", F.lit("mine")).coalesce(1)
    got = media.media_columns(df).collect()
    assert sorted((r.doc_id is None, r.n_bytes) for r in got) == sorted((i is None, len(t)) for i, t in rows)
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == 31
    assert {r.payload_sha256 for r in got} == {hashlib.sha256(t.encode().ljust(64, b"\0")).hexdigest() for _, t in rows}


def test_media_of_an_empty_table(spark):
    assert media.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_damaged_images_are_told():
    image = bytearray(media.to_png(b"x" * 128))
    image[50] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(image))


PARTS = {
    "nav": "<nav><ul><li><a href=/>Home</a></li><li>About us and all the rest of it, at length, for long lines</li></ul></nav>",
    "header": "<header><h2>The site's own name and a motto that goes on for quite a while</h2></header>",
    "ad": "<div class='ad'>Buy now, buy now, buy now, everything must go, only today and here</div>",
    "cookie": "<div id='cookie-notice'>We use cookies for many things, please agree to all of them now</div>",
    "aside": "<aside>Related reading in the sidebar, many words, many words, many words here</aside>",
    "form": "<form><p>Sign up for the newsletter with your address please, it is free of charge</p><button>Go</button></form>",
    "comments": "<section class='comments'><p>First! A reader's comment which is long enough to be taken for text</p></section>",
    "footer": "<footer>&copy; 2024 The owner &middot; all the small print that there is to be read</footer>",
}


@pytest.mark.parametrize("body", ["article", "main", "div class=content"])
def test_main_text(body):
    tag = body.split()[0]
    text = "<h1>A title &amp; more</h1><p>First   paragraph with <b>bold</b>\n text, long enough &eacute; to count.<p>No.</p><p>Last one, of some length again, to end with.</p>"
    page = f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{''.join(PARTS[k] for k in ('nav', 'header', 'ad', 'cookie'))}<{body}>{text}{PARTS['form']}</{tag}>{PARTS['aside']}{PARTS['comments']}{PARTS['footer']}</body></html>"
    assert html_text.main_text(page) == "A title & more\nFirst paragraph with bold text, long enough é to count.\nNo.\nLast one, of some length again, to end with."


@pytest.mark.parametrize(("html", "text"), [(None, ""), ("", ""), ("<nav>x</nav>", ""), ("plain", "plain"), ("<p>a<br>b</p>", "a b"), ("<p>a &lt;b&gt; &#x41;&nbsp;c</p>", "a <b> A c"), ("<![odd", "<![odd"), ("<article>a<p>b", "a\nb"), ("<ul><li>one<li>two</ul>", "one\ntwo")])
def test_small_pages(html, text):
    assert html_text.main_text(html) == text


def test_names_of_blocks():
    """A class only drops a block if it says nothing but what is dropped."""
    kept = "<article><div class='search-results'><p>one two</p></div><div class='notice-board wide'><p>three</p></div></article>"
    assert html_text.main_text(kept) == "one two\nthree"
    gone = "<div class='site-footer'>x</div><div class='ad-container big'>y</div><div id='comments-list'>z</div><article><p>text</p></article>"
    assert html_text.main_text(gone) == "text"


WRITTEN = "What somebody wrote below, and at some length, so that it looks like text of the page itself"


@pytest.mark.parametrize(
    "comments",
    [
        f"<div class='reader-comments'><p>{WRITTEN}</p></div>", f"<section id='user-comments'><h3>Comments</h3><p>{WRITTEN}</p></section>", f"<article class='comment'><p>{WRITTEN}</p></article>",
        f"<article class='comment even'><h4>Somebody</h4><p>{WRITTEN}</p></article>" * 3, f"<ol class='comment-list'><li>{WRITTEN}<li>{WRITTEN}</ol>", f"<div id='disqus_thread'>{WRITTEN}</div>",
        f"<div class='community-comments-v'><p>{WRITTEN}</p></div>".replace("-v", ""), f"<div class='list'><div class='post-comment'><p>{WRITTEN}</p></div></div>",
    ],
)
@pytest.mark.parametrize("inside", [False, True])
def test_comments_are_no_text(comments, inside):
    text = "<h1>A title</h1><p>The first paragraph of the page, long enough to count as one.</p><p>Short.</p>"
    page = f"<body><article>{text}{comments if inside else ''}</article>{'' if inside else comments}</body>"
    assert html_text.main_text(page) == "A title\nThe first paragraph of the page, long enough to count as one.\nShort."


def test_names_that_only_say_whether_there_are_comments():
    assert html_text.main_text("<article class='post comments-open has-comments'><h1>T</h1><p>one two three</p></article>") == "T\none two three"
    assert html_text.main_text("<article><p>one two three</p><section class='comment-policy'><p>four</p></section></article>") == "one two three\nfour"


def test_articles_within_an_article():
    """Without a heading of their own they are what readers wrote; with one they are parts."""
    inner = f"<article><p>{WRITTEN}</p></article>"
    assert html_text.main_text(f"<article><h1>T</h1><p>one two three</p>{inner}{inner}</article>") == "T\none two three"
    assert html_text.main_text(f"<main><article><h2>T</h2><p>one two three</p></article>{inner}</main>") == f"T\none two three\n{WRITTEN}"
    parts = "<article><h1>T</h1><article><h2>A</h2><p>one</p></article><article><h2>B</h2><p>two</p></article></article>"
    assert html_text.main_text(parts) == "T\nA\none\nB\ntwo"


def test_lists_of_links_are_menus():
    links = "".join(f"<li><a href='/{i}'>Where the link number {i} leads to, in many words</a></li>" for i in range(6))
    prose = "<p>Text of the page without an article element, of some length, with <a href='/x'>a link</a> in it.</p>" * 2
    want = "\n".join(["Text of the page without an article element, of some length, with a link in it."] * 2)
    assert html_text.main_text(f"<body><div><ul>{links}</ul></div><div>{prose}</div></body>") == want
    assert html_text.main_text(f"<body><div>{prose}</div><div class='related-stories'>{links}</div></body>") == want
    # in an article a list of links is part of it, and a page of nothing else keeps them
    assert html_text.main_text(f"<article>{prose}<ul>{links}</ul></article>").count("\n") == 7
    assert html_text.main_text(f"<ul>{links}</ul>").count("\n") == 5


def built_page(rng):
    """A page and its text, put together from known parts."""
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(n))
    title, blocks, text = words(6), [], []
    for _ in range(rng.randint(3, 12)):
        kind, line = rng.randrange(5), words(rng.choice([1, 3, 30, 80]))
        made = {
            0: (f"<p>{line}</p>", [line]), 1: (f"<h2>{line}</h2>", [line]), 2: (f"<ul><li>{line}</li><li>{title}</li></ul>", [line, title]),
            3: (f"<blockquote>\n <p>{line}</p></blockquote>", [line]), 4: (f"<div><p>{line} <a href='/y'>alpha</a> &amp; <em>so</em> on</p></div>", [f"{line} alpha & so on"]),
        }[kind]
        blocks.append(made[0])
        text += made[1]
    clutter = [*PARTS.values(), f"<div class='reader-comments'><p>{words(40)}</p></div>", f"<article class='comment'><p>{words(50)}</p></article>", f"<section id='comments'><h3>3 comments</h3><p>{words(30)}</p></section>",
               f"<div class='share-buttons'>{''.join(f'<a href=/{i}>{words(4)}</a> ' for i in range(4))}</div>", f"<script>var x = '<p>{words(9)}</p>'</script>", f"<!-- {words(9)} --><style>p {{}}</style>", f"<div hidden><p>{words(20)}</p></div>"]
    rng.shuffle(clutter)
    cut = rng.randrange(len(clutter))
    inner = [f"<form><input name=q><p>{words(12)}</p></form>", f"<aside><p>{words(25)}</p></aside>", f"<div class='advert'>{words(30)}</div>"][: rng.randrange(4)]
    for part in inner:
        blocks.insert(rng.randrange(len(blocks) + 1), part)
    tag = rng.choice(["article", "main", "article class='post entry'", "main id=content"])
    page = f"<!DOCTYPE html><html><head><title>{words(5)}</title></head><body>{''.join(clutter[:cut])}<{tag}><h1>{title}</h1>{''.join(blocks)}</{tag.split()[0]}>{''.join(clutter[cut:])}</body></html>"
    return page, "\n".join([title, *text])


def test_built_pages_come_back(spark):
    rng = random.Random(12)
    made = [built_page(rng) for _ in range(300)]
    df = spark.createDataFrame([(i % 7 if i % 5 else None, str(i), page) for i, (page, _) in enumerate(made)], "page_id long, url string, html string")
    got = {r.url: r.text for r in html_text.extract(df.repartition(3)).collect()}
    assert {k: v for k, v in got.items()} == {str(i): text for i, (_, text) in enumerate(made)}


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "</span>" * 60_000 + "<p>end", "<p><div>" + "<b>" * 60_000 + "<hr>" * 60_000 + "end", "<article>" + "<i><p>x" * 60_000])
def test_deep_pages_take_one_pass(page):
    began = time.perf_counter()
    assert html_text.main_text(page)
    assert time.perf_counter() - began < 20


def test_pages_that_are_not_utf8(spark):
    df = spark.sql("select 1L page_id, 'u' url, cast(X'3C703E61FF' as string) html")
    assert html_text.extract(df).first().text == "a\ufffd"


def test_marked_lines_lie_within_the_text(spark, sf_dir):
    """On the table every marked line is part of the text, and regions add the short ones."""
    marked = every = 0
    for (page,) in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect():
        lines = html_text.read_lines(page)
        text = html_text.main_text(page).split("\n")
        found = [t for (t, _, _), m in zip(lines, html_text.marked_lines(lines)) if m]
        assert set(found) <= set(text)
        marked, every = marked + len(found), every + len(text)
    assert marked < every


def test_pages_table(spark, sf_dir):
    got = html_text.op6_html(spark, sf_dir)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) and r.text for r in rows)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(empty).count() == 0
    odd = spark.createDataFrame([(1, None, None, "t"), (1, "u", "<p>x" * 5000, "t")], "page_id long, url string, html string, text string")
    assert sorted(r.n_chars for r in html_text.extract(odd).collect()) == [0, 9999]


def naive_best_fit(items, capacity):
    """The tightest compatible bin by looking at all of them."""
    bins, out = [], [None] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-items[i][0], i)):
        size, source, cluster = items[i]
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= size and cluster not in b["clusters"] and b["sources"].count(source) < packing.SLOTS]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"left": capacity, "clusters": set(), "sources": []})
        bins[k]["left"] -= size
        bins[k]["clusters"].add(cluster)
        bins[k]["sources"].append(source)
        out[i] = k
    return out


def test_packing_is_best_fit_under_constraints():
    rng = random.Random(8)
    items = [(rng.randint(1, 60), rng.randrange(6), rng.randrange(40)) for _ in range(400)]
    got = [p[0][0] for p in packing.pack_shard(items, 100)]
    assert got == naive_best_fit(items, 100)


def test_packing_covers_every_word_once(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([0, 1, 50, 700, 2048, 5000]), f"s{i % 3}" if i % 7 else None) for i in range(300)]
    rows += [(1000, None, "s"), (1001, "same words", "a"), (1002, "Same,  words", "b"), (5, "again", "s1"), (None, "no id", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, bin_id string")
    got = packing.pack(df).collect()
    words, bins = {}, {}
    for r in got:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.n_words
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    want = {}
    for i, t, _ in rows:
        want[i] = want.get(i, 0) + len((t or "").split())
    assert words == want
    for parts in bins.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_words
        assert at <= packing.CAPACITY
    of = {r.doc_id: r.bin_id for r in got}
    assert of[1001] != of[1002]  # copies but for case and punctuation
    assert packing.pack(df.limit(0)).count() == 0


def test_near_copies_never_share_a_bin(spark):
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join([*words[:at], "other", *words[at + 1 :]]) for at in range(10, 90, 8)]
    rows = [(i, t, f"s{i % 5}") for i, t in enumerate(texts)] + [(None, texts[3].upper() + "!", "t")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by_bin = {}
    for r in got:
        by_bin.setdefault(r.bin_id, []).append(r.doc_id)
    assert len(got) == len(rows) and all(len(x) == 1 for x in by_bin.values())


def test_repeated_and_missing_ids_spread_over_shards(spark):
    rows = [(None if i % 2 else 7, f"text number {i} of many", "s") for i in range(400)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard_rows=40).collect()
    per_shard = Counter(r.bin_id.split("-")[0] for r in got)
    assert len(got) == 400 and len(per_shard) == 10 and max(per_shard.values()) < 80


def test_registered_packing_fills_bins_of_different_documents(spark, sf_dir):
    """Capacity, source and cluster limits, and words, over the whole table; clusters by brute-force similarity of shingles."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    bins, words = {}, Counter()
    for r in packing.op5_packing(spark, sf_dir).collect():
        words[r.doc_id] += r.n_words
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    assert words == {i: len((d.text or "").encode().split()) for i, d in docs.items()}

    def shingles(doc_id):
        w = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (docs[doc_id].text or "").lower()).split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    for held in bins.values():
        assert sum(r.n_words for r in held) <= packing.CAPACITY
        assert max(Counter(docs[r.doc_id].source for r in held).values()) <= packing.SLOTS
        sets = [shingles(r.doc_id) for r in held]
        assert not any(5 * len(a & b) >= 4 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])


def test_pipeline_stages(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_dedup", "suffix_array_dedup", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_near_dedup_stage_keeps_one_of_each_group(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(3, text, None, None, 1), (2, text, "en", "s", 1), (9, text + " more", "en", "s", 1), (4, " ".join(f"v{i}" for i in range(200)), "en", "s", 1), (None, text, None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, df, sf_dir)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4]
