"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads windows of bytes in both directions (a reset gate is left out: one update gate
and a candidate per unit, so a step costs two thirds of a full gated unit), labels every byte, and
a document's probabilities are the mean of those of its letters. It is trained in numpy by
backpropagation through time on a bounded sample of labelled texts; predictions read whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.llm.common import table

UNITS = 12
STEPS = 64
#: Labelled texts of each language that training sees at most, whole; longer ones than so many bytes only where others are lacking.
SAMPLE_TEXTS = 100
LONG_BYTES = 1 << 20
EPOCHS = 4
BATCH = 256
RATE = 0.02
#: Windows that one matrix holds.
AT_ONCE = 4096
UNDETERMINED = "und"
HELD_OUT = 2


@dataclass
class Model:
    """``w[d]``: byte to gate inputs, ``u[d]``: state to gate inputs, per direction; ``v``, ``c``: to languages."""

    langs: list[str]
    w: np.ndarray  # (2, 257, 2 * UNITS); 256 stands for "no byte"
    u: np.ndarray  # (2, UNITS, 2 * UNITS)
    v: np.ndarray  # (2 * UNITS, languages)
    c: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _states(w: np.ndarray, u: np.ndarray, x: np.ndarray, back: bool, keep: list | None = None) -> np.ndarray:
    """States (steps, rows, UNITS) of one direction over ``x`` (steps, rows) of byte codes."""
    n = u.shape[0]
    uz, uc = np.ascontiguousarray(u[:, :n]), np.ascontiguousarray(u[:, n:])
    h = np.zeros((x.shape[1], n), np.float32)
    out = np.empty((*x.shape, n), np.float32)
    for t in range(len(x) - 1, -1, -1) if back else range(len(x)):
        inputs = w[x[t]]
        z = _sigmoid(inputs[:, :n] + h @ uz)
        g = z * h
        c = np.tanh(inputs[:, n:] + g @ uc)
        new = g + (1 - z) * c
        if keep is not None:
            keep.append((t, h, z, c))
        out[t] = h = new
    return out


def _backward(w, u, x, keep, dout, dw, du):
    """Backpropagation through time; adds to ``dw`` and ``du``."""
    n = u.shape[0]
    uz, uc = u[:, :n], u[:, n:]
    dh = np.zeros_like(keep[0][1])
    for t, h, z, c in reversed(keep):
        d = dout[t] + dh
        dc = d * (1 - z) * (1 - c * c)
        dg = d + dc @ uc.T
        dz = (dg * h - d * c) * z * (1 - z)
        du[:, n:] += (z * h).T @ dc
        du[:, :n] += h.T @ dz
        np.add.at(dw, x[t], np.concatenate([dz, dc], axis=1))
        dh = dg * z + dz @ uz.T


def windows(text: bytes) -> np.ndarray:
    """The whole text as rows of STEPS byte codes; the last row is filled with 256."""
    n = -(-len(text) // STEPS) * STEPS
    codes = np.full(n, 256, np.int16)
    codes[: len(text)] = np.frombuffer(text, np.uint8)
    return codes.reshape(-1, STEPS)


def is_letter_byte(codes: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and of characters beyond ASCII."""
    low = codes | 32
    return ((low >= 97) & (low <= 122) & (codes < 128)) | ((codes >= 128) & (codes < 256))


def train(samples: list[tuple[str, bytes]], seed: int = 4) -> Model:
    """Fits the network to all windows of labelled texts by Adam; the same samples give the same model."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for lang, _ in samples})
    rows = [(langs.index(lang), row) for lang, text in samples for row in windows(text)]
    y = np.array([r[0] for r in rows], np.int64)
    x = np.stack([r[1] for r in rows]).astype(np.int64) if rows else np.empty((0, STEPS), np.int64)
    n, k = UNITS, max(1, len(langs))
    shapes = [(2, 257, 2 * n), (2, n, 2 * n), (2 * n, k), (k,)]
    p = [rng.normal(0, s, shape).astype(np.float32) for s, shape in zip((0.3, 0.3, 0.2, 0.0), shapes)]
    m, q = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    weight = 1 / np.maximum(1, np.bincount(y, minlength=k)) if len(y) else np.ones(k)
    weight = (weight / weight.mean()).astype(np.float32)
    step = 0
    total = EPOCHS * -(-len(x) // BATCH)
    for _ in range(EPOCHS if len(langs) > 1 else 0):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            pick = order[at : at + BATCH]
            xb, yb = x[pick].T, y[pick]
            keeps = ([], [])
            hs = np.concatenate([_states(p[0][d], p[1][d], xb, bool(d), keeps[d]) for d in (0, 1)], axis=2)
            prob = _softmax(hs @ p[2] + p[3])
            mask = is_letter_byte(xb).astype(np.float32) * weight[yb]
            prob[:, np.arange(len(yb)), yb] -= 1
            d_logit = prob * (mask / max(1.0, mask.sum()))[:, :, None]
            grads = [np.zeros_like(a) for a in p]
            grads[2] += np.einsum("tbh,tbk->hk", hs, d_logit)
            grads[3] += d_logit.sum(axis=(0, 1))
            dh = d_logit @ p[2].T
            for d in (0, 1):
                _backward(p[0][d], p[1][d], xb, keeps[d], dh[:, :, d * n : (d + 1) * n], grads[0][d], grads[1][d])
            step += 1
            rate = RATE * (1 - 0.9 * step / total)
            for a, g, mm, qq in zip(p, grads, m, q):
                np.clip(g, -1, 1, out=g)
                mm += 0.1 * (g - mm)
                qq += 0.001 * (g * g - qq)
                a -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(qq / (1 - 0.999**step)) + 1e-8)
    return Model(langs, *p)


def label_positions(model: Model, rows: np.ndarray) -> np.ndarray:
    """Probabilities (rows, STEPS, languages) of every position."""
    x = np.ascontiguousarray(rows.T).astype(np.int64)
    n = model.u.shape[1]
    forward = _states(model.w[0], model.u[0], x, False)
    logits = (forward.reshape(-1, n) @ model.v[:n]).reshape(*x.shape, -1)
    logits += (_states(model.w[1], model.u[1], x, True).reshape(-1, n) @ model.v[n:]).reshape(logits.shape) + model.c
    np.exp(logits - logits.max(axis=2, keepdims=True), out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits.transpose(1, 0, 2)


def predict(model: Model, texts: list[bytes]) -> list[tuple[str, float]]:
    """Language and its pooled probability of each whole text; UNDETERMINED and 0 without a letter."""
    if not model.langs:
        return [(UNDETERMINED, 0.0)] * len(texts)
    rows = [windows(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(r) for r in rows])
    every = np.concatenate(rows) if rows else np.empty((0, STEPS), np.int16)
    sums = np.zeros((len(texts), len(model.langs) + 1))
    for at in range(0, len(every), AT_ONCE):
        part = every[at : at + AT_ONCE]
        letters = is_letter_byte(part).astype(np.float32)
        found = np.empty((len(part), len(model.langs) + 1))
        found[:, -1] = letters.sum(axis=1)
        found[:, :-1] = np.einsum("rtk,rt->rk", label_positions(model, part), letters)
        np.add.at(sums, owner[at : at + AT_ONCE], found)
    out = []
    for text, row in zip(texts, sums):
        if row[-1] == 0 or not any(map(str.isalpha, text.decode("utf-8", "replace"))):
            out.append((UNDETERMINED, 0.0))
            continue
        best = int(row[:-1].argmax())
        out.append((model.langs[best], float(min(1.0, row[best] / row[-1]))))
    return out


def training_sample(docs: DataFrame) -> list[tuple[str, bytes]]:
    """At most SAMPLE_TEXTS whole texts of each language.

    The texts are those of the smallest hashed ids, texts of over LONG_BYTES after all others; each language's limit is applied
    before the shuffle. Rows without a language or text aren't learnt from.
    """
    place = F.row_number().over(Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id", "text"), "doc_id"))
    picked = (
        docs.where(F.col("lang").isNotNull() & (F.length("text") > 0))
        .select(F.col("lang").cast("string"), "doc_id", F.col("text").cast("string"), (F.octet_length("text") > LONG_BYTES).alias("long"))
        .withColumn("place", place)
        .where(F.col("place") <= SAMPLE_TEXTS)
        .select("lang", F.col("text").cast("binary").alias("text"))
    )
    return sorted((r.lang, bytes(r.text)) for r in picked.collect())


def held_out(column: str = "doc_id"):
    """True for the quarter of ids that training never sees; false without an id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of every row; null and letterless texts are ``und``, 0.

    Rows that repeat an id or have none are judged one by one; other columns don't matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few ten KB: UNITS and the languages bound it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found, size = [], [], 0
            for t in batch.column(2).cast(pa.binary()):
                texts.append(t.as_py() or b"")
                size += len(texts[-1])
                if size > AT_ONCE * STEPS:
                    found += predict(shared.value, texts)
                    texts, size = [], 0
            found += predict(shared.value, texts)
            yield pa.record_batch(
                [*batch.columns[:2], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of every document."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(training_sample(docs.where(~held_out()))))
