"""Near-duplicate documents by SimHash.

Fingerprints are embedded as the bit counts of their segments. The Manhattan distance of two embeddings
never exceeds the Hamming distance of the fingerprints, so it bounds it from below: whoever is within
four differing bits is within a distance of four there.

The grid join of that range: the segments are split into b groups, and embeddings within a distance of four agree in
at least b - 4 of them, as each unit of distance spoils one group at most. So the cells are the counts in every choice of b - 4 groups;
those who share a cell are candidates, the Manhattan distance over all segments thins them out, and the exact Hamming
distance decides. Segments are two bits wide, and one bit from some hundred thousand fingerprints on; their width and the number of groups
follow the number of fingerprints, so that a fingerprint meets a few chance neighbours at any size. Which pairs are found doesn't depend on it.

Equal fingerprints are one node, so copies make no pairs; the graph knows fingerprints only, ids come in last.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import connected_components, stored, table

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
#: Chance neighbours of a fingerprint that are fine.
CHANCE = 4
#: How likely the counts of two random segments of a width are equal.
EQUAL = {2: 0.375, 1: 0.5}
#: The lower bit of every two.
LOW = 0x5555555555555555


def shingle_hashes(text: bytes | None, size: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of each word shingle of the lower-cased text, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxh64_intdigest(joined, SEED)] if words else []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [
        xxh64_intdigest(joined[s:e], SEED)
        for s, e in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    ]


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 of none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8)).reshape(-1, 64)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (long, the fingerprint's 64 bits) of every whole text.

    Null and wordless texts get 0; texts of fewer than four words hash as one shingle. Other
    columns of the input don't matter. One row per input row, repeated ids included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            fps = np.fromiter((majority(shingle_hashes(t.as_py())) for t in texts), np.uint64, len(texts))
            yield pa.record_batch([ids, pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, fp long"
    )


class Grid(NamedTuple):
    """Segments of ``width`` bits in so many ``groups``."""

    width: int
    groups: int


#: From the coarsest on.
GRIDS = (Grid(2, 8), Grid(1, 7), Grid(1, 8), Grid(1, 9), Grid(1, 10))


def grid_for(n: int, max_bits: int = MAX_BITS, chance: int = CHANCE) -> Grid:
    """The first grid in which ``n`` random fingerprints have at most ``chance`` candidates each."""
    if max_bits > GRIDS[-1].groups - 2:
        raise ValueError("more differing bits than the groups can cover")
    for width, groups in GRIDS:
        alike = groups - max_bits
        if alike > 0 and n * comb(groups, alike) * EQUAL[width] ** (64 / width * alike / groups) <= chance:
            return Grid(width, groups)
    return GRIDS[-1]


def cell_masks(grid: Grid, max_bits: int = MAX_BITS) -> list[int]:
    """For each choice of ``groups`` - ``max_bits`` groups their bits in an embedding, as longs."""
    segments = 64 // grid.width
    ends = [grid.width * (segments * i // grid.groups) for i in range(grid.groups + 1)]
    each = [(1 << hi) - (1 << lo) for lo, hi in zip(ends, ends[1:])]
    found = [sum(c) for c in combinations(each, grid.groups - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def embedded(fp: Column, width: int) -> Column:
    """The bit counts of all segments, packed in a long: two bits for each segment of two, where 3 doesn't occur."""
    if width == 1:
        return fp
    high = F.shiftrightunsigned(fp, 1)
    low = F.lit(LOW)
    return fp.bitwiseXOR(high).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(low), 1))


def manhattan(a: Column, b: Column, width: int) -> Column:
    """Distance of two embeddings: counts that differ by one have different last bits, those that differ by two only different first ones."""
    apart = a.bitwiseXOR(b)
    if width == 1:
        return F.bit_count(apart)
    ones = apart.bitwiseAND(F.lit(LOW))
    twos = F.shiftrightunsigned(apart, 1).bitwiseAND(F.lit(LOW)).bitwiseAND(F.bitwise_not(ones))
    return F.bit_count(ones) + 2 * F.bit_count(twos)


def print_links(nodes: DataFrame, grid: Grid, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``a`` < ``b`` of distinct fingerprints (``fp``) within ``max_bits``. Each pair comes once: only its first common cell emits it.

    Spark takes the cells to be as small as the nodes' file, as it doesn't know how many rows a node makes; so the join is told to sort.
    """
    masks = cell_masks(grid, max_bits)
    cells = nodes.withColumn("e", embedded(F.col("fp"), grid.width)).select(
        "fp", F.posexplode(F.array(*[F.col("e").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "cell")
    )
    a = cells.select(F.col("choice").alias("choice_a"), F.col("cell").alias("cell_a"), F.col("fp").alias("a"))
    b = cells.select("choice", "cell", F.col("fp").alias("b"))
    ea, eb = embedded(F.col("a"), grid.width), embedded(F.col("b"), grid.width)
    apart = ea.bitwiseXOR(eb)
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(k)) for k, m in enumerate(masks)])
    near = (
        (F.col("a") < F.col("b"))
        & (manhattan(ea, eb, grid.width) <= max_bits)
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
        & (first == F.col("choice_a"))
    )
    return a.join(b.hint("merge"), (F.col("choice_a") == F.col("choice")) & (F.col("cell_a") == F.col("cell")) & near).select("a", "b")


def _nodes(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints with their smallest id; null if none of their rows has one."""
    return stored(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``a`` < ``b`` of the smallest ids of fingerprints within ``max_bits`` of each other; ``prints`` has ``doc_id`` and ``fp``.

    Fingerprints whose rows have no id, and pairs with one id for both, aren't shown; ``components`` links them, too.
    """
    nodes = _nodes(prints)
    pairs = print_links(nodes, grid_for(nodes.count(), max_bits), max_bits)
    of = lambda side: nodes.select(F.col("fp").alias(side), F.col("node").alias(f"id_{side}"))
    return (
        pairs.join(of("a"), "a").join(of("b"), "b").where("id_a <> id_b")
        .select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
    )


def components(prints: DataFrame, max_bits: int = MAX_BITS, chance: int = CHANCE) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id``: the smallest id reachable over links, itself included.

    The nodes are fingerprints. A row without an id takes part like any other, links others, and has the component's smallest
    id, or null if no row there has one. Rows of one id with different texts are joined only by what their texts are.
    """
    nodes = _nodes(prints)
    groups = connected_components(print_links(nodes, grid_for(nodes.count(), max_bits, chance), max_bits))
    of_print = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "node", F.coalesce("component", "fp").alias("root"))
    least = of_print.groupBy("root").agg(F.min("node").alias("component_id"))
    of_print = stored(of_print.join(least, "root").select("fp", "component_id"), "print-components")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Every document with ``fingerprint`` (16 hex digits) and ``component_id``. Null, empty and wordless texts have fingerprint zero."""
    prints = stored(fingerprints(docs), "prints")
    return components(prints).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
