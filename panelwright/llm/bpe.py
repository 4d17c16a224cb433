"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut where a rolling hash of 32 bytes has its low bits clear, so equal passages of
different documents are cut alike. Documents are sent to tasks by the smallest rolling hash of
their windows: copies and near copies meet in one task, where each distinct chunk is encoded once
while it is remembered. Keys that hold more than a thousandth of the bytes are split over several tasks.

A chunk's own encoding may be wrong near its ends. So at each join the end of one chunk and the start
of the next, two words of each, are encoded again together. The outer word on either side has to get
the very ids that it has in its chunk; then the window's ids take the place of the chunks' ids there.
If they differ, the two chunks are encoded as one, and so on until all joins agree: at worst that
is the whole text.

Decoding looks ids up in a table of their bytes. Chunks of common scripts are encoded by a faster
implementation of the same merges, all others by the library itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import stored, table
from panelwright.llm.rolling import MOST, Rolling

VOCABULARY = "byte_bpe_50k.json"
WIDTH = 32
MASK = np.uint64((1 << 10) - 1)
LEAST_CHUNK = 256
#: A routing key is split if it has more than this share of all bytes, or more bytes than a task should take.
HEAVY = 0.001
TASK_BYTES = 64 << 20
#: Bytes that a task remembers, about; beyond that it starts anew.
HELD = 64 << 20
#: Ends of words: ASCII white space after a character that surely is none.
EDGE = re.compile(rb"(?:(?<=[\x21-\x7e])|(?<=[\xc3-\xdf][\x80-\xbf])|(?<=[\xe4-\xed][\x80-\xbf]{2}))(?=[\x09-\x0d\x20])")
#: Word ends that a chunk needs: two at either end.
LEAST_EDGES = 4
#: Characters whose classes don't depend on the edition of Unicode: ASCII, Latin, Greek, Cyrillic, common punctuation.
COMMON = re.compile("[\x00-\u024f\u0391-\u03a1\u03a3-\u03ce\u0410-\u044f\u2010-\u2027\u20ac]*")
#: The tokenizer's splitting pattern, with possessive repeats. A fixed value.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@cache
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable ones for themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def bytes_of(path: str) -> list[bytes]:
    """The bytes that each id decodes to."""
    letters, tok = byte_letters(), tokenizer(path)
    added = tok.get_added_tokens_decoder()
    return [
        added[i].content.encode() if i in added else bytes(letters[x] for x in tok.id_to_token(i) or "")
        for i in range(tok.get_vocab_size())
    ]


@cache
def fast_encoder(path: str):
    """Text to ids by a second implementation of the merges, or None for a vocabulary that it can't stand in for."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, split = told["model"], told["pre_tokenizer"]
    options = ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "dropout", "byte_fallback", "ignore_merges")
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    order = [model["vocab"][x] for x in joined]
    plain = split == split | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    special = {t["content"]: t["id"] for t in told["added_tokens"]}
    exact = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in told["added_tokens"])
    if not plain or told["normalizer"] or any(model.get(o) for o in options) or order != sorted(order) or not exact:
        return None
    letters = byte_letters()
    ranks = {bytes(letters[x] for x in t): i for t, i in model["vocab"].items() if t not in special}
    found = tiktoken.Encoding("fast", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)
    return lambda text: found.encode(text, allowed_special=allowed, disallowed_special=())


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks of a text, always between characters, the text's end last."""
    found: list[int] = []
    for start in range(0, max(len(text), 1), MOST - WIDTH):
        part = np.frombuffer(text, np.uint8, min(MOST, len(text) - start), start)
        found += (np.flatnonzero((Rolling(part, seed=10).windows(WIDTH) & MASK) == 0) + start + WIDTH).tolist()
    ends, last = [], 0
    for end in found:
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        if end - last >= LEAST_CHUNK and end < len(text):
            ends.append(end)
            last = end
    return [*ends, len(text)]


def pieces(raw: bytes) -> list[bytes]:
    """The chunks of a text; chunks with too few words are joined to the next, at the end to the one before."""
    out, start, edges, searched = [], 0, 0, 0
    for end in (ends := cuts(raw)):
        edges += sum(1 for _ in islice(EDGE.finditer(raw, searched, end), LEAST_EDGES))
        searched = end
        if edges >= LEAST_EDGES:
            out.append(raw[start:end])
            start, edges = end, 0
    if start < ends[-1]:
        out[-1:] = [b"".join([*out[-1:], raw[start:]])]
    return out


class Part(NamedTuple):
    """Ids in a row: their number, their decimals each with a comma, and the bytes that they decode to."""

    n: int
    decimals: str
    decoded: bytes


class Chunk(NamedTuple):
    """An encoded chunk: up to its second word end, between, and from its last but one word end on.

    ``first`` and ``last`` are those ends' bytes, ``first_ids`` and ``last_ids`` the outer word's ids there.
    """

    head: Part
    core: Part
    tail: Part
    first: bytes
    last: bytes
    first_ids: list[int]
    last_ids: list[int]


class Coder:
    """Encodes texts; what equal chunks and equal joins need is encoded once while it is remembered."""

    def __init__(self, path: str):
        self.tok, self.fast, self.bytes = tokenizer(path), fast_encoder(path), bytes_of(path)
        self.lengths = np.array(list(map(len, self.bytes)), np.int64)
        self.decimals = [f"{i}," for i in range(len(self.bytes))]
        self.chunks: dict[bytes, Chunk] = {}
        self.joins: dict[tuple[bytes, bytes], list[int]] = {}
        self.held = 0
        self.encoded = 0

    def ids(self, raw: bytes) -> list[int]:
        text = raw.decode("utf-8")
        self.encoded += len(raw)
        if self.fast is not None and COMMON.fullmatch(text):
            return self.fast(text)
        return self.tok.encode(text, add_special_tokens=False).ids

    def part(self, ids: list[int]) -> Part:
        return Part(len(ids), "".join(map(self.decimals.__getitem__, ids)), b"".join(map(self.bytes.__getitem__, ids)))

    def chunk(self, raw: bytes) -> Chunk:
        if (known := self.chunks.get(raw)) is not None:
            return known
        ids = self.ids(raw)
        heads = [m.start() for m in islice(EDGE.finditer(raw), 2)]
        reach = 64
        while len(tails := [m.start() for m in EDGE.finditer(raw, max(0, len(raw) - reach))][-2:]) < 2 and reach < len(raw):
            reach *= 4
        ends = np.cumsum(self.lengths[ids])
        marks = np.array([*heads, *tails], np.int64)
        at = np.searchsorted(ends, marks)
        sound = len(marks) == 4 and heads[1] <= tails[0] and (ends[np.minimum(at, len(ends) - 1)] == marks).all()
        if sound:
            a, b, c, d = (at + 1).tolist()
            found = Chunk(
                self.part(ids[:b]), self.part(ids[b:c]), self.part(ids[c:]), raw[: heads[1]], raw[tails[0] :], ids[a:b], ids[c:d]
            )
        else:  # nothing to compare: a join makes it one with its neighbour
            found = Chunk(self.part(ids), Part(0, "", b""), Part(0, "", b""), b"", b"", [], [])
        self.chunks[raw] = found
        self.held += 6 * len(raw) + 1000
        return found

    def join(self, left: Chunk, right: Chunk) -> list[int] | None:
        """The ids of the words around a join; None if they don't agree with the chunks' ids on both sides."""
        if not left.last_ids or not right.first_ids:
            return None
        key = (left.last, right.first)
        if (ids := self.joins.get(key)) is None:
            ids = self.joins[key] = self.ids(left.last + right.first)
            self.held += 3 * len(left.last + right.first) + 400
        n, m = len(left.last_ids), len(right.first_ids)
        return ids if ids[:n] == left.last_ids and ids[-m:] == right.first_ids and len(ids) >= n + m else None

    def code(self, raw: bytes) -> Part:
        """All ids of a text."""
        if self.held > HELD:
            self.chunks.clear()
            self.joins.clear()
            self.held = 0
        raws = pieces(raw)
        if not raws:
            return Part(0, "", b"")
        out, i = [self.chunk(raws[0])], 1
        between: list[list[int]] = []
        while i < len(raws):
            out.append(self.chunk(raws[i]))
            i += 1
            while len(out) > 1 and len(between) < len(out) - 1:
                if (ids := self.join(out[-2], out[-1])) is not None:
                    between.append(ids)
                else:
                    raws[i - 2 : i] = [raws[i - 2] + raws[i - 1]]
                    i -= 1
                    out[-2:] = [self.chunk(raws[i - 1])]
                    if between:
                        between.pop()
        parts = [out[0].head]
        for chunk, ids in zip(out, between):
            parts += [chunk.core, self.part(ids)]
        return Part(*(f(x) for f, x in zip((sum, "".join, b"".join), zip(*[*parts, out[-1].core, out[-1].tail]))))


def smallest_windows(texts: list[bytes]) -> np.ndarray:
    """The smallest rolling hash of WIDTH bytes of each text; of shorter texts that of the padded text."""
    out = np.full(len(texts), np.iinfo(np.uint64).max, np.uint64)
    group, size = [], 0

    def settle() -> None:
        raw = np.frombuffer(b"".join(p for _, p in group), np.uint8)
        found = Rolling(raw, seed=10).windows(WIDTH)
        starts = np.cumsum([0, *(len(p) for _, p in group[:-1])])
        stops = starts + [len(p) - WIDTH + 1 for _, p in group]
        least = np.minimum.reduceat(found, np.stack([starts, np.minimum(stops, len(found) - 1)], axis=1).ravel())[::2]
        np.minimum.at(out, [i for i, _ in group], least)

    for i, text in enumerate(texts):
        text = text.ljust(WIDTH, b"\0")
        for start in range(0, len(text) - WIDTH + 1, MOST // 2):
            piece = text[start : start + MOST // 2 + WIDTH - 1]
            if size + len(piece) > MOST:
                settle()
                group, size = [], 0
            group.append((i, piece))
            size += len(piece)
    if group:
        settle()
    return out


def route(docs: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``doc_id``, ``text`` dealt out so that documents with common passages meet; heavy keys are split.

    A row's salt is its number within its task, so copies are split whatever their ids are. A task that is run again reads
    the same rows in the same order if ``docs`` is read from files, and so deals them out alike. Texts are hashed twice, once for the
    sizes and once for the rows: storing them with their keys would cost as much disk as the shuffle itself.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            raws = [t.as_py() or b"" for t in batch.column(1).cast(pa.binary())]
            numbers = np.arange(seen, seen + len(raws))
            seen += len(raws)
            yield pa.record_batch(
                [*batch.columns, pa.array(smallest_windows(raws).view(np.int64)), pa.array([len(r) + 1 for r in raws], pa.int64()), pa.array(numbers)],
                ["doc_id", "text", "key", "size", "number"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text").mapInArrow(keys, f"doc_id {kind}, text string, key long, size long, number long")
    sizes = stored(keyed.groupBy("key").agg(F.sum("size").alias("bytes")), "keys")
    most = min(task_bytes, HEAVY * (sizes.agg(F.sum("bytes")).first()[0] or 1))
    # a table of its own, so Spark knows its size: it is broadcast only if it is small
    heavy = stored(sizes.where(F.col("bytes") > most).select("key", F.ceil(F.col("bytes") / F.lit(most)).cast("int").alias("ways")), "heavy")
    return (
        keyed.join(heavy, "key", "left")
        .withColumn("salt", F.coalesce(F.pmod(F.xxhash64("number"), "ways"), F.lit(0)))
        .repartition("key", "salt")
        .sortWithinPartitions("key")
        .select("doc_id", "text")
    )


def encode(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of every whole text (``with_ids``: and ``ids``, ``decoded``).

    Null and empty texts have no tokens. One row per input row, also of rows that repeat an id or have none.
    Bytes that aren't UTF-8 become U+FFFD first. Other columns don't matter.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path)
        for batch in batches:
            counts, ids, decoded, kept = [], [], [], []
            for t in batch.column(1).cast(pa.binary()):
                n, decimals, raw = coder.code((t.as_py() or b"").decode("utf-8", "replace").encode())
                text = raw.decode("utf-8", "replace")
                counts.append(n)
                ids.append(hashlib.sha256(decimals[:-1].encode()).hexdigest())
                decoded.append(hashlib.sha256(text.encode()).hexdigest())
                if with_ids:
                    kept.append(([int(i) for i in decimals.split(",")[:-1]], text))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                columns += [pa.array([k[0] for k in kept], pa.list_(pa.int32())), pa.array([k[1] for k in kept], pa.string())]
            yield pa.record_batch(columns, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (
        ", ids array<int>, decoded string" if with_ids else ""
    )
    return route(docs).mapInArrow(run, schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with ``n_tokens``, ``ids_sha256``, ``decoded_sha256``."""
    return encode(table(spark, sf_dir, "documents"))
