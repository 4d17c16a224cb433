"""Removal of byte strings of LENGTH that occur more than once, exactly and for all texts together.

After the difference-cover construction of suffix arrays, but only as deep as LENGTH bytes:

1. Sample: a cover of positions such that two equal strings of LENGTH bytes hold a sampled position
   at the same offset. Here it is chosen by content, which needs far fewer positions than a cover of
   residues: the smallest hashed GRAM of each string (leftmost on ties). Strings that follow each other
   and share their sample form a segment, about 70 strings on average.
2. Names: samples are named by their gram, segments by all their bytes, and the names are counted. A
   gram that occurs once settles its strings as unique. A segment that occurs twice settles its
   strings as repeated.
3. Recursion on what is left: segments that are unique although their gram is not, as at the ends of
   a repeated passage. Only these are compared string by string, within their gram: the remaining
   strings get names of 128 bits, are sorted by them, and neighbours are compared.

The full suffix array isn't built: the names of all positions would be shuffled several times, which
is more than twenty times the input. The README has figures.

Names are hashes: grams of 64 bits only sieve. To be mistaken for each other, two different segments of
one gram would have to agree in a hash of 64 bits, two different strings in two hashes, that is 128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import stored, table
from panelwright.llm.rolling import MOST, Rolling, least_in_windows

LENGTH = 200
GRAM = 64
#: Segments of one gram that one task compares in memory (about 300 bytes each); grams with more go through shuffles.
TOGETHER = 20_000
INDEX_BITS = 20


def parts(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups (text, start, bytes) of at most MOST bytes; long texts overlap so that no string is lost."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for start in range(0, max(1, len(text) - length + 1), MOST - length + 1):
            piece = text[start : start + MOST]
            if len(piece) < length:
                continue
            if size + len(piece) > MOST:
                yield group
                group, size = [], 0
            group.append((i, start, piece))
            size += len(piece)
    if group:
        yield group


def segments(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Rows (text, first string's start, strings, gram's name, segment's name) that cover all strings of ``length``."""
    found = [np.empty((0, 5), np.int64)]
    low = np.uint64((1 << INDEX_BITS) - 1)
    for group in parts(texts, length):
        sizes = np.array([len(p) for _, _, p in group])
        first = np.cumsum(sizes) - sizes
        which = np.repeat(np.arange(len(group)), sizes)
        rolling = Rolling(np.frombuffer(b"".join(p for _, _, p in group), np.uint8), seed=11)
        names = rolling.windows(gram)
        ranked = (names & ~low) | np.arange(len(names), dtype=np.uint64)
        sample = (least_in_windows(ranked, length - gram + 1) & low).astype(np.int64)
        inside = which[: len(sample)] == which[length - 1 :]
        new = np.ones(len(sample), bool)
        new[1:] = (sample[1:] != sample[:-1]) | ~inside[:-1]
        start = np.flatnonzero(new & inside)
        if not len(start):
            continue
        stops = np.flatnonzero(np.append(new | ~inside, True))
        count = stops[np.searchsorted(stops, start, side="right")] - start
        at = sample[start]
        exact = rolling.spans(start, count + length - 1) ^ ((at - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        owner = which[start]
        found.append(
            np.stack(
                [
                    np.array([i for i, _, _ in group])[owner],
                    start - first[owner] + np.array([s for _, s, _ in group])[owner],
                    count,
                    names[at].view(np.int64),
                    exact.view(np.int64),
                ],
                axis=1,
            )
        )
    return np.concatenate(found)


def repeated_strings(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece, which of its strings of ``length`` occur twice or more in all the pieces."""
    one, two, owner = [], [], []
    for group in parts(pieces, length):
        sizes = np.array([len(p) for _, _, p in group])
        which = np.repeat(np.arange(len(group)), sizes)
        raw = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
        inside = which[: len(raw) - length + 1] == which[length - 1 :]
        one.append(Rolling(raw, seed=12).windows(length)[inside])
        two.append(Rolling(raw, seed=13).windows(length)[inside])
        owner.append(np.array([i for i, _, _ in group])[which[: len(inside)][inside]])
    if not one:
        return [np.zeros(0, bool) for _ in pieces]
    a, b, of = np.concatenate(one), np.concatenate(two), np.concatenate(owner)
    order = np.lexsort((b, a))
    same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    twice = np.zeros(len(a), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    bounds = np.searchsorted(of, np.arange(len(pieces) + 1))
    return [twice[bounds[i] : bounds[i + 1]] for i in range(len(pieces))]


def runs(marks: np.ndarray) -> list[tuple[int, int]]:
    """Start and length of each run of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], marks, [False])).astype(np.int8)))
    return [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2])]


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs of bytes that (start, end) spans cover; spans that touch make one run."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _packed(docs: DataFrame, others: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``part`` (tells rows of equal id apart), the compressed text, and other columns as ``o0``, ``o1`` ...

    Texts are shuffled as these: they take a third of the room.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = [docs.schema[c].dataType.simpleString() for c in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor

        squeeze = ZstdCompressor(level=3).compress
        for batch in batches:
            z = pa.array([squeeze(t.as_py() or b"") for t in batch.column(2).cast(pa.binary())], pa.binary())
            yield pa.record_batch(
                [*batch.columns[:2], z, *batch.columns[3:]], ["doc_id", "part", "z", *(f"o{i}" for i in range(len(others)))]
            )

    return docs.select(
        F.col("doc_id"), F.xxhash64("text").alias("part"), F.col("text"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(others)]
    ).mapInArrow(run, f"doc_id {kind}, part long, z binary" + "".join(f", o{i} {k}" for i, k in enumerate(kinds)))


def _segments(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, done, size = [], 0, 0
            column = batch.column(2).cast(pa.binary())
            for k, t in enumerate(column):
                texts.append(t.as_py() or b"")
                size += len(texts[-1])
                if size > 4 * MOST or k == len(column) - 1:
                    rows = segments(texts)
                    at = pa.array(rows[:, 0] + done)
                    yield pa.record_batch(
                        [batch.column(0).take(at), batch.column(1).take(at), pa.array(rows[:, 1].astype(np.int32)),
                         pa.array(rows[:, 2].astype(np.int32)), pa.array(rows[:, 3]), pa.array(rows[:, 4])],
                        ["doc_id", "part", "at", "n", "gram", "seg"],
                    )
                    texts, done, size = [], k + 1, 0

    return docs.select("doc_id", F.xxhash64("text").alias("part"), "text").mapInArrow(
        run, f"doc_id {kind}, part long, at int, n int, gram long, seg long"
    )


def _compare(pieces: DataFrame) -> DataFrame:
    """Spans of repeated strings in pieces, gram by gram within a task."""
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def solved(rows: list[dict]) -> pa.RecordBatch:
        out = []
        for row, marks in zip(rows, repeated_strings([r["bytes"] for r in rows])):
            if row["alone"]:
                out += [(row["doc_id"], row["part"], row["at"] + o, row["at"] + o + n + LENGTH - 1) for o, n in runs(marks)]
        kinds = [id_type[0], pa.int64(), pa.int32(), pa.int32()]
        columns = zip(*out) if out else ([] for _ in kinds)
        return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["doc_id", "part", "a", "b"])

    id_type: list[pa.DataType] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            id_type[:] = [batch.schema.field("doc_id").type]
            for row in batch.to_pylist():
                if len(rows) >= 4000 and row["gram"] != rows[-1]["gram"]:
                    yield solved(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield solved(rows)

    return (
        pieces.select("gram", "doc_id", "part", "at", "alone", "bytes")
        .repartition("gram")
        .sortWithinPartitions("gram")
        .mapInArrow(run, f"doc_id {kind}, part long, a int, b int")
    )


def _compare_by_shuffle(pieces: DataFrame) -> DataFrame:
    """The same for grams with too many segments for one task: one row per string."""
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for i, row in enumerate(rows):
                raw = np.frombuffer(row["bytes"], np.uint8)
                one = Rolling(raw, seed=12).windows(LENGTH).view(np.int64)
                two = Rolling(raw, seed=13).windows(LENGTH).view(np.int64)
                same = pa.array(np.full(len(one), i))
                yield pa.record_batch(
                    [*(batch.column(c).take(same) for c in ("doc_id", "part", "alone")),
                     pa.array((row["at"] + np.arange(len(one))).astype(np.int32)), pa.array(one), pa.array(two)],
                    ["doc_id", "part", "alone", "a", "one", "two"],
                )

    strings = pieces.select("doc_id", "part", "at", "alone", "bytes").mapInArrow(
        run, f"doc_id {kind}, part long, alone boolean, a int, one long, two long"
    )
    twice = strings.groupBy("one", "two").count().where("count > 1").select("one", "two")
    return strings.where("alone").join(twice, ["one", "two"]).select("doc_id", "part", "a", (F.col("a") + LENGTH).alias("b"))


def repeated_spans(docs: DataFrame, together: int = TOGETHER) -> DataFrame:
    """``doc_id``, ``part`` and ``spans``: the start and end bytes of repeated strings, for texts that have any."""
    found = _segments(docs)
    # written first: a join whose sides are both shuffled for it can split a gram that holds many rows
    grams = stored(
        found.groupBy("gram")
        .agg(F.count("*").alias("c"), F.min("seg").alias("lo"), F.max("seg").alias("hi"))
        .where("c > 1")
        .select("gram", (F.col("lo") != F.col("hi")).alias("mixed")),
        "grams",
    )
    hits = stored(found.join(grams, "gram"), "hits")
    whole = F.col("at") + F.col("n") + (LENGTH - 1)
    sure = hits.where("not mixed").select("doc_id", "part", F.col("at").alias("a"), whole.alias("b"))
    mixed = hits.where("mixed")
    names = stored(
        mixed.groupBy("gram", "seg").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "part", "at", "n")).alias("first")),
        "names",
    )
    twice = mixed.join(names.where("c > 1").select("gram", "seg"), ["gram", "seg"], "left_semi")
    of_gram = names.groupBy("gram").agg(F.count("*").alias("kinds"))
    needed = (
        names.join(of_gram, "gram")
        .select("first.*", "gram", (F.col("c") == 1).alias("alone"), (F.col("kinds") > together).alias("many"))
        .groupBy("doc_id", "part")
        .agg(F.collect_list(F.struct("at", "n", "gram", "alone", "many")).alias("wanted"))
    )
    pieces = _pieces(docs, needed)
    compared = _compare(pieces.where("not many"))
    if names.groupBy("gram").count().where(F.col("count") > together).limit(1).count():
        compared = compared.union(_compare_by_shuffle(pieces.where("many")))
    return (
        sure.union(twice.select("doc_id", "part", F.col("at").alias("a"), whole.alias("b")))
        .union(compared)
        .groupBy("doc_id", "part")
        .agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    )


def _pieces(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """The bytes of the wanted segments, fetched from their texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdDecompressor

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text = ZstdDecompressor().decompress(r["z"])
                rows += [(r["doc_id"], r["part"], w["at"], w["gram"], w["alone"], w["many"], text[w["at"] : w["at"] + w["n"] + LENGTH - 1]) for w in r["wanted"]]
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
            columns = zip(*rows) if rows else ([] for _ in kinds)
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["doc_id", "part", "at", "gram", "alone", "many", "bytes"])

    texts = _packed(docs).dropDuplicates(["doc_id", "part"])
    return _match(texts, needed, "inner").select("doc_id", "part", "z", "wanted").mapInArrow(
        run, f"doc_id {kind}, part long, at int, gram long, alone boolean, many boolean, bytes binary"
    )


def _match(texts: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Joins on id and part; a null id matches a null id."""
    found = found.withColumnsRenamed({"doc_id": "of_id", "part": "of_part"})
    return texts.join(found, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("part") == F.col("of_part")), how)


def remaining(docs: DataFrame, together: int = TOGETHER, others: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (binary) of every row, then other columns as ``o0`` ...

    Null and empty texts are empty, texts shorter than LENGTH stay whole. Repeated rows repeat each
    other, so all their strings go. A cut may fall within a character: ``kept`` is bytes.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = [docs.schema[c].dataType.simpleString() for c in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdDecompressor

        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for z, found in zip(batch.column(1), batch.column(2).to_pylist()):
                text = ZstdDecompressor().decompress(z.as_py())
                cut = covered([(s["a"], s["b"]) for s in found or ()])
                rest = [text[a:b] for a, b in zip([0, *(b for _, b in cut)], [*(a for a, _ in cut), len(text)])]
                sizes.append(len(text))
                removed.append(sum(b - a for a, b in cut))
                spans.append(len(cut))
                kept.append(b"".join(rest))
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, removed, spans)), pa.array(kept, pa.binary()), *batch.columns[3:]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *(f"o{i}" for i in range(len(kinds)))],
            )

    return (
        _match(_packed(docs, others), repeated_spans(docs, together), "left")
        .select("doc_id", "z", "spans", *(f"o{i}" for i in range(len(others))))
        .mapInArrow(
            run,
            f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
            + "".join(f", o{i} {k}" for i, k in enumerate(kinds)),
        )
    )


def keep_unrepeated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with what remains of their texts and, if there is such a column, their new ``n_chars``.

    Bytes of a character that was cut go too. Rows of which nothing remains go, as do null and empty texts.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    back = {c: F.col(f"o{i}") for i, c in enumerate(others)}
    text = F.try_validate_utf8(F.col("kept").cast("string"))
    rest = remaining(docs, others=others)
    mended = rest.withColumn("text", F.coalesce(text, F.make_valid_utf8(F.col("kept").cast("string"))))
    mended = mended.withColumn("text", F.when(text.isNull(), F.translate("text", "\ufffd", "")).otherwise(F.col("text")))
    return (
        mended.withColumn("n_chars", F.length("text").cast("long"))
        .where("n_chars > 0")
        .select(*[back[c].alias(c) if c in back else F.col(c) for c in docs.columns])
    )


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` of every row."""
    return remaining(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its bytes, removed bytes and runs, and the hash of what is left."""
    return suffix_dedup(table(spark, sf_dir, "documents"))
