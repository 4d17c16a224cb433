"""Toxicity by a chain of linear classifiers.

Features are byte n-grams of the lower-cased text, hashed; for each category those most associated
with it in the training rows are kept. The categories are predicted in order, and every model also
reads the probabilities of the earlier categories. In training these come out of fold, so a later
model never sees how well an earlier one has learnt its own rows by heart.

The label table has two columns to learn from, so the chain is (low quality, toxic). Training reads a
bounded sample of labelled rows, see MOST_POSITIVE and MOST_NEGATIVE, with their whole texts. The
texts stay in Spark tasks: these count n-grams, choose features, and fit each fold. The driver only
sees the chosen features, a bit for each feature and row, and the weights.

Scoring reads whole texts in windows of WINDOW bytes, as presence says less the longer a text is; the
highest probability of any window counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.llm.common import stored, table
from panelwright.llm.rolling import MOST, Rolling

WIDTHS = (5, 8)
BITS = 20
FEATURES = 1500
LEAST_SUPPORT = 5
FOLDS = 4
ROUNDS = 250
PENALTY = 1e-3
#: Rows of the sample with and without the last category, at most.
MOST_POSITIVE = 2500
MOST_NEGATIVE = 5000
#: A document of a lower probability is never called toxic: with few toxic rows to learn from, the best F1 says little.
LEAST_THRESHOLD = 0.2
#: Tasks that count and fit.
TASKS = 12
#: Parts that the n-grams' counts are merged in.
BLOCKS = 64
#: Bytes that are scored together.
WINDOW = 1 << 16
CATEGORIES = ("low_quality", "toxic")
NON_LETTERS = re.compile("[\x00-`{-\x7f]+")


def normal(text: bytes | None) -> bytes:
    """Lower case, every run of ASCII non-letters one space, a space at both ends."""
    return f" {NON_LETTERS.sub(' ', (text or b'').decode('utf-8', 'replace').lower())} ".encode()


def buckets(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text index and hashed n-gram of all places, in parts of bounded size."""
    gap = max(WIDTHS)

    def part(group: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        raw = b"".join(piece.ljust(len(piece) + gap) for _, piece in group)
        owner = np.repeat([i for i, _ in group], [len(piece) + gap for _, piece in group])
        rolling = Rolling(np.frombuffer(raw, np.uint8), seed=7)
        found = [(rolling.windows(w) >> np.uint64(64 - BITS)).astype(np.int32) for w in WIDTHS]
        return np.concatenate([owner[: len(f)] for f in found]), np.concatenate(found)

    group, size = [], 0
    step = MOST // 2
    for i, text in enumerate(texts):
        for start in range(0, len(text), step):
            piece = text[start : start + step + gap]
            if size + len(piece) + gap > MOST:
                yield part(group)
                group, size = [], 0
            group.append((i, piece))
            size += len(piece) + gap
    if group:
        yield part(group)


def distinct(text: bytes) -> np.ndarray:
    """The hashed n-grams of one text, each once."""
    found = [b for _, b in buckets([text])]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int32)


def presence(texts: list[bytes], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, feature), each once; ``index`` maps a hash to a feature or -1."""
    n = int(index.max()) + 1 if len(index) else 0
    hits = [np.empty(0, np.int64)]
    for owner, bucket in buckets(texts):
        feature = index[bucket]
        at = np.flatnonzero(feature >= 0)
        hits.append(np.unique(owner[at].astype(np.int64) * max(n, 1) + feature[at]))
    every = np.unique(np.concatenate(hits))
    return every // max(n, 1), every % max(n, 1)


@dataclass
class Chain:
    """``index``: hash to feature; per category: weights of the features, of earlier logits, and a bias."""

    categories: tuple[str, ...]
    index: np.ndarray
    weights: np.ndarray  # (features, categories)
    links: np.ndarray  # (categories, categories), lower triangle
    bias: np.ndarray
    threshold: float


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * np.clip(x, -60, 60)) + 0.5


def association(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """How much a hash's presence says about a label: the difference of its rates over its standard error.

    ``counts`` (2, hashes) are the rows with the hash, ``totals`` (2,) all rows, without and with the label.
    """
    rate = (counts + 0.5) / (totals[:, None] + 1)
    pooled = (counts.sum(axis=0) + 1) / (totals.sum() + 2)
    spread = np.sqrt(pooled * (1 - pooled) * (1 / (totals[0] + 1) + 1 / (totals[1] + 1)))
    return np.where(counts.sum(axis=0) < LEAST_SUPPORT, 0.0, np.abs(rate[1] - rate[0]) / spread)


def fit(x1: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with a ridge, by accelerated gradient steps; the last column of ``x1`` is 1."""
    n = max(1, len(y))
    top = float(np.einsum("ij,ij->", x1, x1)) / n / 4 + PENALTY
    w = v = np.zeros(x1.shape[1], np.float32)
    ridge = np.full(len(w), PENALTY, np.float32)
    ridge[-1] = 0
    for k in range(ROUNDS):
        grad = x1.T @ (sigmoid(x1 @ v) - y).astype(np.float32) / n + ridge * v
        new = v - grad / top
        v = new + (k / (k + 3)) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def best_threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The probability with the best F1 over these rows; halfway to the next lower one."""
    if not (y > 0).any():
        return 1.0
    order = np.argsort(-logits, kind="stable")
    right = np.cumsum(y[order] > 0)
    f1 = 2 * right / (np.arange(1, len(y) + 1) + (y > 0).sum())
    k = int(f1.argmax())
    p = sigmoid(logits[order].astype(np.float64))
    return float((p[k] + p[min(k + 1, len(p) - 1)]) / 2)


def score(chain: Chain, texts: list[bytes | None]) -> np.ndarray:
    """Probabilities (texts, categories) of whole texts, each the highest of any of the text's windows."""
    owner, pieces = [], []
    for i, text in enumerate(map(normal, texts)):
        for start in range(0, len(text), WINDOW):
            owner.append(i)
            pieces.append(text[start : start + WINDOW + max(WIDTHS) - 1])
    logits = np.tile(chain.bias, (len(pieces), 1))
    if len(chain.weights):
        place, feature = presence(pieces, chain.index)
        np.add.at(logits, place, chain.weights[feature])
    for c in range(len(chain.categories)):
        logits[:, c] += logits[:, :c] @ chain.links[c, :c]
    out = np.zeros((len(texts), len(chain.categories)))
    np.maximum.at(out, np.array(owner, int), sigmoid(logits))
    return out


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The sample, stored: ``doc_id``, ``text``, ``fold`` and ``code`` (a bit for each category) of labelled documents.

    Those of the smallest hashed ids, as many toxic and other ones as the limits say. Rows without an id or
    a toxic label aren't learnt from; of rows that repeat an id the smallest text is.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
        .select("doc_id", (F.col("toxic") > 0).alias("toxic"), (F.coalesce("quality", F.lit(1)) == 0).alias("low_quality"))
    )
    by_hash = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = (
        known.where("toxic").orderBy(*by_hash).limit(MOST_POSITIVE)
        .union(known.where("not toxic").orderBy(*by_hash).limit(MOST_NEGATIVE))
        .select("doc_id", F.expr(" + ".join(f"if({c}, {1 << i}, 0)" for i, c in enumerate(CATEGORIES))).alias("code"))
    )
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return stored(
        rows.join(F.broadcast(picked), "doc_id")  # at most MOST_POSITIVE + MOST_NEGATIVE rows
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.first("code").alias("code"))
        .withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int"))
        .repartition(TASKS),
        "toxicity-sample",
    )


def _cells() -> int:
    return FOLDS << len(CATEGORIES)


def chosen_features(rows: DataFrame, totals: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """(fold, category): hashes to learn from, chosen in the rows outside of the fold; fold FOLDS stands for all rows.

    Tasks count the rows with each hash for each fold and code, in tables of a fixed size that are merged
    block by block.
    """
    from zstandard import ZstdCompressor, ZstdDecompressor

    width = (1 << BITS) // BLOCKS
    codes = np.arange(_cells()) % (1 << len(CATEGORIES))
    folds = np.arange(_cells()) >> len(CATEGORIES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((_cells(), 1 << BITS), np.uint16)  # the sample has fewer rows than 2**16
        for batch in batches:
            for text, fold, code in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                table[fold << len(CATEGORIES) | code, distinct(normal(text.as_py()))] += 1
        squeeze = ZstdCompressor(level=1).compress
        z = [squeeze(np.ascontiguousarray(table[:, b * width : (b + 1) * width]).data) for b in range(BLOCKS)]
        yield pa.record_batch([pa.array(range(BLOCKS), pa.int32()), pa.array(z, pa.binary())], ["block", "z"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, z in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(ZstdDecompressor().decompress(z.as_py()), np.uint16).reshape(_cells(), width)
                sums[block] = sums.get(block, 0) + part.astype(np.int32)
        for block, counts in sums.items():
            for fold in range(FOLDS + 1):
                for c in range(len(CATEGORIES)):
                    sides = [(folds != fold) & (codes >> c & 1 == side) for side in (0, 1)]
                    found = association(np.stack([counts[s].sum(axis=0) for s in sides]), np.array([totals[s].sum() for s in sides], float))
                    best = np.argsort(-found, kind="stable")[:FEATURES]
                    best = best[found[best] > 3]
                    same = [np.full(len(best), x, np.int32) for x in (fold, c)]
                    yield pa.record_batch(
                        [*map(pa.array, same), pa.array((best + block * width).astype(np.int32)), pa.array(found[best])],
                        ["of_fold", "category", "hash", "score"],
                    )

    place = F.row_number().over(Window.partitionBy("of_fold", "category").orderBy(F.desc("score"), "hash"))
    best = (
        rows.select("text", "fold", "code")
        .mapInArrow(count, "block int, z binary")
        .repartition("block")
        .mapInArrow(choose, "of_fold int, category int, hash int, score double")
        .withColumn("place", place)  # at most FEATURES rows a block, fold and category
        .where(F.col("place") <= FEATURES)
        .select("of_fold", "category", "hash")
        .collect()
    )
    out: dict[tuple[int, int], list[int]] = {(f, c): [] for f in range(FOLDS + 1) for c in range(len(CATEGORIES))}
    for r in best:
        out[r.of_fold, r.category].append(r.hash)
    return {k: np.array(sorted(v), np.int64) for k, v in out.items()}


def feature_bits(rows: DataFrame, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits (rows, hashes / 8), folds and codes of the sample's rows: what the driver sees of them."""
    index = np.full(1 << BITS, -1, np.int32)
    index[hashes] = np.arange(len(hashes))
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(3).cast(pa.binary()):
                bits = np.zeros(len(hashes), bool)
                at = shared.value[distinct(normal(text.as_py()))]
                bits[at[at >= 0]] = True
                out.append(np.packbits(bits).tobytes())
            yield pa.record_batch([*batch.columns[:3], pa.array(out, pa.binary())], ["doc_id", "fold", "code", "bits"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.select("doc_id", "fold", "code", "text").mapInArrow(run, f"doc_id {kind}, fold int, code int, bits binary").orderBy("doc_id").collect()
    shared.unpersist()
    bits = np.frombuffer(b"".join(bytes(r.bits) for r in found), np.uint8).reshape(len(found), -(-len(hashes) // 8))
    return bits, np.array([r.fold for r in found], np.int64), np.array([r.code for r in found], np.int64)


def fitted(docs: DataFrame, labels: DataFrame) -> Chain:
    """Fits the chain; the threshold of the last category maximises F1 out of fold.

    Without rows, or without both classes, a category's probability is the smoothed rate of its label.
    Folds are fitted side by side, category after category.
    """
    spark, k = docs.sparkSession, len(CATEGORIES)
    rows = training_rows(docs, labels)
    totals = np.zeros(_cells(), np.int64)
    for r in rows.groupBy("fold", "code").count().collect():
        totals[r.fold << k | r.code] = r["count"]
    chosen = chosen_features(rows, totals)
    hashes = np.unique(np.concatenate(list(chosen.values())))
    bits, folds, codes = feature_bits(rows, hashes)
    n = len(bits)
    labelled = np.stack([codes >> c & 1 for c in range(k)], axis=1).astype(np.float32)
    earlier = np.zeros((n, k), np.float32)  # logits, out of fold
    index = np.full(1 << BITS, -1, np.int32)
    index[hashes] = np.arange(len(hashes))
    weights, links, bias = np.zeros((len(hashes), k)), np.zeros((k, k)), np.zeros(k)
    for c in range(k):
        y = labelled[:, c]
        if len(np.unique(y)) < 2:
            rate = (y.sum() + 0.5) / (n + 1)
            earlier[:, c] = bias[c] = np.log(rate / (1 - rate))
            continue
        for f, (w, b, logits) in enumerate(_folds(spark, bits, folds, y, earlier[:, :c], [index[chosen[f, c]] for f in range(FOLDS + 1)])):
            if f < FOLDS:
                earlier[folds == f, c] = logits
            else:
                at = index[chosen[f, c]]
                weights[at, c], links[c, :c], bias[c] = w[: len(at)], w[len(at) :] / 4, b
    threshold = max(LEAST_THRESHOLD, best_threshold(earlier[:, -1], labelled[:, -1]))
    return Chain(CATEGORIES, index, weights, links, bias, threshold)


def _folds(spark: SparkSession, bits: np.ndarray, folds: np.ndarray, y: np.ndarray, earlier: np.ndarray, columns: list[np.ndarray]):
    """For each fold, and for all rows: weights and bias fitted outside of it, and the logits of its own rows."""
    shared = spark.sparkContext.broadcast((bits, folds, y, earlier, columns))  # bits: the sample's rows by the chosen hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, folds, y, earlier, columns = shared.value
        for batch in batches:
            for f in batch.column(0).to_pylist():
                x = np.ones((len(bits), len(columns[f]) + earlier.shape[1] + 1), np.float32)
                for at in range(0, len(bits), 512):
                    x[at : at + 512, : len(columns[f])] = np.unpackbits(bits[at : at + 512], axis=1)[:, columns[f]]
                x[:, len(columns[f]) : -1] = earlier / 4
                w, b = fit(x[folds != f], y[folds != f])
                logits = x[folds == f, :-1] @ w + np.float32(b)
                yield pa.record_batch(
                    [pa.array([f]), pa.array([w.tobytes()], pa.binary()), pa.array([b]), pa.array([logits.astype(np.float32).tobytes()], pa.binary())],
                    ["fold", "w", "b", "logits"],
                )

    found = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(run, "fold long, w binary, b double, logits binary").collect()
    shared.unpersist()
    return [(np.frombuffer(r.w, np.float32), r.b, np.frombuffer(r.logits, np.float32)) for r in sorted(found, key=lambda r: r.fold)]


def _scores(chain: Chain, column: pa.Array) -> np.ndarray:
    out, group, size = [np.empty((0, len(chain.categories)))], [], 0
    for t in column.cast(pa.binary()):
        group.append(t.as_py())
        size += len(group[-1] or b"")
        if size > MOST:
            out.append(score(chain, group))
            group, size = [], 0
    return np.concatenate([*out, score(chain, group)]) if group else np.concatenate(out)


def toxicity(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id``, a probability per category, ``toxic`` and ``kept`` for every row; no shuffle.

    Null and empty texts get the probabilities of a text without any feature. Rows that repeat an id or
    have none are judged one by one; other columns don't matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # about 4 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _scores(shared.value, batch.column(1))
            toxic = p[:, -1] > shared.value.threshold
            yield pa.record_batch(
                [batch.column(0), *(pa.array(p[:, c]) for c in range(p.shape[1])), pa.array(toxic), pa.array(~toxic)],
                ["doc_id", *(f"p_{c}" for c in shared.value.categories), "toxic", "kept"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, " + ", ".join(f"p_{c} double" for c in chain.categories) + ", toxic boolean, kept boolean"
    )


def keep_clean(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, all columns as they were; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(shared.value, batch.column(at))[:, -1] <= shared.value.threshold))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``p_low_quality``, ``p_toxic``, ``toxic``, ``kept`` of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fitted(docs, table(spark, sf_dir, "labels")))
