"""Exact top-k search by inner product: distributed selection over score histograms.

Queries and candidates are dealt to cells of a grid, one block of queries and one of candidates each; a cell
streams its candidates past its queries, so a task holds one block of queries. Every pass scores every pair.
A histogram pass counts the scores of each query within that query's range, by 1,024 bins; summed over the
cells, the counts tell in which bin the k-th score lies, and that bin is the next pass's range. A cell only
sends the bins down to its own k-th score, as the k-th of all scores can't be lower. Once bins are one wide
the k-th score is known exactly, and the last pass sends what is above it and, of what equals it, as many rows
of the smallest ids as are still wanted. So what leaves a cell is at most k rows a query, however many copies
of a vector there are.

The cells are the blocks of a stated query set against all rows; there is no other way to score everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.llm.common import stored, table
from panelwright.llm.vectors import scaled, usable

K = 20
SCALE = 64
EVERY = 20
#: Rows of a block of queries or candidates, and queries in one matrix product.
CELL = 8192
STEP = 512
BIN_BITS = 10
BINS = 1 << BIN_BITS
#: Scores beyond this count as this.
LIMIT = 1 << 61
#: Below any score: the query's own row.
OWN = -(1 << 63)


def products(q: np.ndarray, c: np.ndarray, q_norm: float, c_norm: float) -> np.ndarray:
    """Inner products of whole-numbered rows, exact: in the narrowest floats that hold every partial sum."""
    bound = q_norm * c_norm * 1.001
    if bound < 1 << 24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (q @ c.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    found = whole(q) @ whole(c).T if q.shape[1] else np.zeros((len(q), len(c)), object)
    return np.clip(found, -LIMIT, LIMIT).astype(np.int64)


class _Cell:
    """The queries of one cell, and what a pass has found for them so far."""

    def __init__(self, parts: list[dict], pick: bool):
        self.q, self.row, self.low, self.above = (np.concatenate([p[k] for p in parts]) for k in ("x", "row", "low", "above"))
        self.id = pa.concat_arrays([p["id"] for p in parts])
        self.norm = np.sqrt((self.q * self.q).sum(1))
        self.order = np.argsort(self.row)
        self.taken = np.zeros(len(self.q), np.int64)
        self.counts = None if pick else np.zeros((len(self.q), BINS), np.int32)

    def own(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (query, candidate) at which a query meets its own row."""
        at = np.minimum(np.searchsorted(self.row, rows, sorter=self.order), len(self.row) - 1)
        place = self.order[at]
        same = np.flatnonzero(self.row[place] == rows)
        return place[same], same


def _scores(cell: _Cell, chunk: dict) -> Iterator[tuple[slice, np.ndarray]]:
    q, c = cell.own(chunk["row"])
    norm = math.sqrt((chunk["x"] * chunk["x"]).sum(1).max())
    for start in range(0, len(cell.q), STEP):
        part = slice(start, min(start + STEP, len(cell.q)))
        found = products(cell.q[part], chunk["x"], float(cell.norm[part].max()), norm)
        mine = (q >= part.start) & (q < part.stop)
        found[q[mine] - start, c[mine]] = OWN
        yield part, found


def _count(cell: _Cell, chunk: dict, shift: int, width: int) -> None:
    for part, found in _scores(cell, chunk):
        low = cell.low[part, None]
        bins = (found - low).view(np.uint64) >> np.uint64(shift)
        inside = (found >= low) & (bins < width)
        flat = np.arange(len(found))[:, None] * BINS + bins.astype(np.int64)
        cell.counts[part] += np.bincount(flat[inside], minlength=len(found) * BINS).reshape(-1, BINS).astype(np.int32)


def _counted(cell: _Cell, k: int) -> pa.RecordBatch:
    """The bins from the top down to the one with the cell's own k-th score."""
    upto = cell.counts[:, ::-1].cumsum(1)[:, ::-1]
    q, b = np.nonzero((cell.counts > 0) & (upto - cell.counts < (k - cell.above)[:, None]))
    return pa.record_batch(
        [pa.array(cell.row[q]), pa.array(cell.low[q]), pa.array(cell.above[q]), pa.array(b.astype(np.int64)), pa.array(cell.counts[q, b].astype(np.int64))],
        ["row", "low", "above", "bin", "n"],
    )


def _picked(cell: _Cell, chunk: dict, k: int) -> Iterator[pa.RecordBatch]:
    """What is above the k-th score, and the first of what equals it: candidates come in the order that breaks ties."""
    for part, found in _scores(cell, chunk):
        kth = cell.low[part, None]
        ties = found == kth
        wanted = k - cell.above[part] - cell.taken[part]
        ties &= ties.cumsum(1) <= wanted[:, None]
        cell.taken[part] += ties.sum(1)
        q, c = np.nonzero((found > kth) | ties)
        if len(q):
            at = pa.array(q + part.start)
            yield pa.record_batch(
                [pa.array(cell.row[part][q]), cell.id.take(at), pa.array(chunk["row"][c]), chunk["id"].take(pa.array(c)), pa.array(found[q, c])],
                ["row", "query_id", "other", "vec_id", "score"],
            )


def _pass(dims: int, scale: float, k: int, shift: int | None, width: int):
    """A pass over cells, sorted with the queries first: counts ``width`` bins of ``1 << shift``, or picks if ``shift`` is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, cell = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            candidate = batch.column(1).to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((np.diff(keys) != 0) | np.diff(candidate)) + 1
            for start, end in zip([0, *turns], [*turns, len(keys)]):
                if keys[start] != at:
                    if cell is not None and shift is not None:
                        yield _counted(cell, k)
                    at, parts, cell = keys[start], [], None
                piece = batch.slice(start, end - start)
                rows = {"row": piece.column(2).to_numpy(), "id": piece.column(3), "x": scaled(piece.column(4), dims, scale)}
                if not candidate[start]:
                    parts.append(rows | {"low": piece.column(5).to_numpy(), "above": piece.column(6).to_numpy()})
                elif parts or cell:
                    cell = cell or _Cell(parts, shift is None)
                    if shift is None:
                        yield from _picked(cell, rows, k)
                    else:
                        _count(cell, rows, shift, width)
        if cell is not None and shift is not None:
            yield _counted(cell, k)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: float = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", cell: int = CELL) -> DataFrame:
    """``query_id``, ``rank`` (int, from 1), ``vec_id``, ``score`` (long): the ``k`` best of every other row for each query.

    A vector's components become floor(scale * x). Null vectors and those with a null or non-finite component take no part.
    The score is the integer inner product; of vectors of different length the missing components count as zero, and
    scores beyond 2**61 count as that. Ties go to the smaller id, rows without an id come last among them, and
    rows of one id in the order of a stored row number. A row is its own query's only by that number: other rows of the same
    id or vector are candidates, and each of several query rows of an id has ``k`` rows of its own. Rows for which
    ``is_query`` is null are no queries. With fewer than ``k`` other rows all are returned, with none the result is
    empty, as it is for an empty table. Other columns don't matter.
    """
    rows = stored(
        vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("query"))
        .where(usable(F.col("vec")))
        .withColumn("row", F.monotonically_increasing_id()),
        "topk-rows",
    )
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.pow(F.floor(x.cast("double") * scale).cast("double"), F.lit(2.0)))
    n, n_queries, dims, top = rows.agg(F.count("*"), F.count_if("query"), F.max(F.size("vec")), F.max(square)).first()
    k = min(k, n - 1)
    kind = vectors.schema[id_col].dataType.simpleString()
    if k < 1 or not n_queries:
        return rows.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")
    # no score is beyond the largest square
    bound = LIMIT if not top < LIMIT / 2 else int(top * 1.001) + 1
    shift = max(0, (2 * bound).bit_length() - BIN_BITS)

    spark = rows.sparkSession
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    q_blocks = -(-n_queries // cell)
    c_blocks = max(-(-n // cell), min(n // STEP, slots // q_blocks), 1)
    parts = min(q_blocks * c_blocks, slots)
    block = lambda m: F.pmod(F.xxhash64("row"), F.lit(m))
    others = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), block(c_blocks).alias("cb"), F.lit(True).alias("candidate"),
        "row", "vec_id", "vec", F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("above"),
    )

    def passed(state: DataFrame | None, shift: int | None, width: int, schema: str) -> DataFrame:
        own = rows.where("query")
        own = own.withColumns({"low": F.lit(-bound), "above": F.lit(0)}) if state is None else own.join(state, "row")
        own = own.select(
            block(q_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"), F.lit(False).alias("candidate"),
            "row", "vec_id", "vec", F.col("low").cast("long"), F.col("above").cast("long"),
        )
        cells = own.union(others).select((F.col("qb") * c_blocks + F.col("cb")).cast("long").alias("cell"), "candidate", "row", "vec_id", "vec", "low", "above")
        return (
            cells.repartitionById(parts, F.pmod("cell", F.lit(parts)).cast("int"))
            .sortWithinPartitions("cell", "candidate", F.col("vec_id").asc_nulls_last(), "row")
            .mapInArrow(_pass(dims, scale, k, shift, width), schema)
        )

    state, width = None, BINS
    while True:
        counts = passed(state, shift, width, "row long, low long, above long, bin long, n long").groupBy("row", "low", "above", "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("row").orderBy(F.desc("bin")))
        state = stored(
            counts.withColumn("upto", upto + F.col("above"))
            .where((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k))
            .select("row", (F.col("low") + F.col("bin") * F.lit(1 << shift)).alias("low"), (F.col("upto") - F.col("n")).alias("above")),
            "topk-state",
        )
        if shift == 0:
            break
        # the last pass may divide a bin into fewer than BINS
        width = 1 << min(shift, BIN_BITS)
        shift = max(0, shift - BIN_BITS)
    found = passed(state, None, 0, f"row long, query_id {kind}, other long, vec_id {kind}, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
