"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Documents are dealt over shards of bounded size by a stored row number, so a hot source is spread
evenly and one task never holds more than a shard's rows; every shard packs on its own. Within a
shard documents go in from the longest to the shortest. Open bins are kept in the order of their
residual capacity; from the first bin that is large enough, the search goes on to the next larger
one until a compatible bin is found, which so is the tightest compatible one. Bins carry two bitmaps:
one of the duplicate clusters they hold (two documents of a cluster never share a bin; a cluster is a
group of linked near copies, see ``near_copies``, case and ASCII punctuation apart) and one of their sources, with SLOTS bits each (at most so many documents of a source share a bin).

A document longer than a bin is cut: its full pieces fill bins of their own, the rest is packed.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import connected_components, stored, table
from panelwright.llm.near_copies import band_keys, described, near_copies, row_key

CAPACITY = 2048
SLOTS = 4
SOURCE_BITS = 64
CLUSTER_BITS = 1024
#: Rows of a shard, about. More rows make more shards, never larger ones.
SHARD_ROWS = 4096


class Packer:
    """Best fit over bins ordered by residual capacity."""

    def __init__(self, capacity: int = CAPACITY, slots: int = SLOTS):
        self.capacity, self.slots = capacity, slots
        self.order: list[tuple[int, int]] = []  # (residual, bin), open bins only
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.used: list[int] = []

    def _slot(self, held: int, source: int) -> int:
        """The first free bit of a source, or 0. Sources that share their bits only conflict more often."""
        first = source % SOURCE_BITS * self.slots
        for k in range(self.slots):
            if not held >> (first + k) & 1:
                return 1 << (first + k)
        return 0

    def add(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and place in it; ``size`` is at most the capacity."""
        bit = 1 << cluster % CLUSTER_BITS
        for at in range(bisect_left(self.order, (size, -1)), len(self.order)):
            residual, b = self.order[at]
            if not self.clusters[b] & bit and (slot := self._slot(self.sources[b], source)):
                del self.order[at]
                break
        else:
            b, residual, slot = len(self.used), self.capacity, self._slot(0, source)
            self.sources.append(0)
            self.clusters.append(0)
            self.used.append(0)
        place = self.used[b]
        self.used[b] += size
        self.sources[b] |= slot
        self.clusters[b] |= bit
        if residual > size:
            insort(self.order, (residual - size, b))
        return b, place


def pack_shard(items: list[tuple[int, int, int]], capacity: int = CAPACITY) -> list[list[tuple[int, int, int, int]]]:
    """For each (size, source, cluster): its pieces as (bin, place in the bin, place in the document, size).

    Empty documents take no room and have no piece. Ties go by the order of the items.
    """
    packer = Packer(capacity)
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in items]
    rests = []
    for i, (size, source, cluster) in enumerate(items):
        for at in range(0, size - size % capacity, capacity):
            out[i].append((*packer.add(capacity, source, cluster), at, capacity))
        if size % capacity:
            rests.append((size % capacity, i))
    for rest, i in sorted(rests, key=lambda r: (-r[0], r[1])):
        size, source, cluster = items[i]
        out[i].append((*packer.add(rest, source, cluster), size - rest, rest))
    return out


PUNCTUATION = bytes(c for c in range(128) if not chr(c).isalnum())
SPACED = bytes.maketrans(PUNCTUATION, b" " * len(PUNCTUATION))


def bare_text(text: bytes) -> bytes:
    """The text without case; ASCII punctuation and controls are spaces."""
    return text.decode("utf-8", "replace").lower().encode().translate(SPACED)


def clustered(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``source`` and ``cluster`` (hashes) and ``at`` (a number of its own) of every row, stored."""
    keyed = docs.select(
        row_key().alias("doc_id"), F.col("doc_id").alias("id"),
        F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit(""))).alias("source"), F.col("text").cast("string").alias("text"),
    )
    described_rows = described(keyed, "bands", band_keys, ("id", "source"), bare_text, words=True)
    rows = stored(described_rows.withColumn("at", F.monotonically_increasing_id()), "packing")
    groups = connected_components(near_copies(keyed.select("doc_id", "text"), rows.select("doc_id", "same", "n", "bands"), bare_text))
    return rows.join(groups, F.col("same") == F.col("node"), "left").select(
        F.col("id").alias("doc_id"), "size", "source", F.coalesce("component", "same").alias("cluster"), "at"
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``bin_id`` (shard and number), ``bin_offset``, ``doc_offset``, ``n_words``.

    ``docs`` has ``doc_id``, ``text`` and ``source``. Null and wordless texts give one row with a
    null bin and no words, so every document is in the result. Rows of equal id are packed separately. Rows
    are dealt by the number that was stored with them, so rows that repeat an id or have none spread, too.
    """
    rows = clustered(docs)
    shards = max(1, -(-docs.select("doc_id").count() // shard_rows))
    names = ["doc_id", "piece", "bin_id", "bin_offset", "doc_offset", "n_words"]

    def packed(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        columns = [t[c].to_pylist() for c in ("doc_id", "size", "source", "cluster")]
        order = sorted(range(len(t)), key=lambda i: (columns[0][i] is not None, columns[0][i], columns[1][i], columns[3][i]))
        items = [(columns[1][i], columns[2][i] & (1 << 64) - 1, columns[3][i] & (1 << 64) - 1) for i in order]
        out: list[tuple] = []
        for i, pieces in zip(order, pack_shard(items, capacity)):
            if not pieces:
                out.append((columns[0][i], 0, None, None, 0, 0))
            for k, (b, place, at, size) in enumerate(pieces):
                out.append((columns[0][i], k, f"{shard}-{b}", place, at, size))
        kinds = [t.schema.field("doc_id").type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; one shard is held at a time."""
        shard, parts = None, []
        for batch in batches:
            of = batch.column("shard").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if parts and of[a] != shard:
                    yield packed(shard, parts)
                    parts = []
                shard = int(of[a])
                parts.append(batch.slice(a, b - a))
        if parts:
            yield packed(shard, parts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        rows.withColumn("shard", F.pmod(F.xxhash64("at"), F.lit(shards)))
        .repartition("shard")
        .sortWithinPartitions("shard")
        .mapInArrow(run, f"doc_id {kind}, piece long, bin_id string, bin_offset long, doc_offset long, n_words long")
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place: ``doc_id``, ``piece``, ``bin_id``, ``bin_offset``, ``doc_offset``, ``n_words``."""
    return pack(table(spark, sf_dir, "documents"))
