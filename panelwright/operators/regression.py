"""A regressor that can be fitted, saved and loaded: boosted stumps, fitted by grouped sums and scored as an expression.

Targets, residuals and leaves are whole millionths, so sums don't depend on the order of rows or the number of partitions: the same
rows always give the same model. A feature is cut into equal bins between its least and largest value; missing
values are in the first one. A round needs one pass over a stored table of bins: counts and sums of residuals per feature and
bin are all that leaves Spark, and they decide the split.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.errors import ModelLoadError
from panelwright.functions.numeric import finite
from panelwright.functions.shared import stored
from panelwright.settings import MODEL_COLUMNS

UNIT = 1_000_000
BINS = 16
ROUNDS = 20
RATE = 0.5
NAME = "XGBoost"


@dataclass(frozen=True)
class Stump:
    """Adds ``right`` where the feature is at least ``edge``, else ``left``; both in millionths."""

    feature: str
    edge: float
    left: int
    right: int


@dataclass(frozen=True)
class Regressor:
    columns: tuple[str, ...]
    base: int
    stumps: tuple[Stump, ...]

    def prediction(self) -> Column:
        """The raw prediction from the columns of a row. Missing features count as small, NaN as large."""
        total = F.lit(self.base)
        for s in self.stumps:
            total = total + F.when(F.col(s.feature) >= s.edge, F.lit(s.right)).otherwise(F.lit(s.left))
        return total.cast("double") / F.lit(float(UNIT))

    def text(self) -> str:
        return json.dumps({"columns": self.columns, "base": self.base, "stumps": [[s.feature, s.edge, s.left, s.right] for s in self.stumps]})


def fit(df: DataFrame, target: str, columns: Sequence[str] = MODEL_COLUMNS, rounds: int = ROUNDS, bins: int = BINS, rate: float = RATE) -> Regressor:
    """Fits to all rows whose ``target`` is finite. Splits of equal gain: the first column, then the lowest edge.

    Ends early when no column can be split. Without a row to learn from it raises ValueError.
    """
    columns = tuple(columns)
    known = df.where(finite(F.col(target)))
    ends = known.select(*[F.when(finite(F.col(c)), F.col(c)).alias(c) for c in columns]).agg(
        *[F.min(c).alias(f"lo_{i}") for i, c in enumerate(columns)], *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(columns)]
    ).first()
    edges = []
    for i in range(len(columns)):
        lo, hi = ends[f"lo_{i}"], ends[f"hi_{i}"]
        edges.append([] if lo is None else [lo + (hi - lo) * k / bins for k in range(1, bins)])
    in_bin = [sum((F.coalesce((F.col(c) >= e).cast("int"), F.lit(0)) for e in edges[i]), F.lit(0)) for i, c in enumerate(columns)]
    rows = stored(
        known.select(F.floor(F.col(target) * float(UNIT) + 0.5).cast("long").alias("y"), F.array(*in_bin).alias("bins")), "regression-bins"
    )
    n, total = rows.agg(F.count("*"), F.sum("y")).first()
    if not n:
        raise ValueError("no row has a target")
    base = math.floor(total / n + 0.5)
    splits: list[tuple[int, int, int, int]] = []
    for _ in range(rounds):
        left = F.col("y") - base
        for f, k, low, high in splits:
            left = left - F.when(F.get("bins", F.lit(f)) >= k, F.lit(high)).otherwise(F.lit(low))
        each = rows.select(left.alias("r"), F.posexplode("bins").alias("f", "bin"))
        sums = each.groupBy("f", "bin").agg(F.count("*").alias("n"), F.sum("r").alias("s")).collect()
        split = _best({(r.f, r.bin): (r.n, r.s) for r in sums}, len(columns), bins, rate)
        if split is None:
            break
        splits.append(split)
    return Regressor(columns, base, tuple(Stump(columns[f], edges[f][k - 1], low, high) for f, k, low, high in splits))


def _best(sums: dict[tuple[int, int], tuple[int, int]], features: int, bins: int, rate: float) -> tuple[int, int, int, int] | None:
    """Feature, bin at which the right side begins, and both leaves."""
    found, most = None, -1.0
    for f in range(features):
        at = [sums.get((f, b), (0, 0)) for b in range(bins)]
        n, s = (sum(v[i] for v in at) for i in (0, 1))
        nl = sl = 0
        for k in range(1, bins):
            nl, sl = nl + at[k - 1][0], sl + at[k - 1][1]
            nr, sr = n - nl, s - sl
            if not nl or not nr:
                continue
            gain = float(sl) * float(sl) / float(nl) + float(sr) * float(sr) / float(nr)
            if gain > most:
                found, most = (f, k, math.floor(rate * (sl / nl) + 0.5), math.floor(rate * (sr / nr) + 0.5)), gain
    return found


def save(spark: SparkSession, model: Regressor, path: str) -> None:
    """One row: the model as JSON and its digest. Fails if there is something at ``path``."""
    text = model.text()
    spark.createDataFrame([(text, hashlib.sha256(text.encode()).hexdigest())], "model string, sha256 string").coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> Regressor:
    """The saved model. ModelLoadError if it isn't there, was changed, can't be read, or is one of other columns than ``columns``."""
    try:
        rows = spark.read.schema("model string, sha256 string").parquet(path).take(2)
    except (PySparkException, Py4JJavaError) as problem:
        kind = (problem.getCondition() if isinstance(problem, PySparkException) else None) or type(problem).__name__
        raise ModelLoadError("Pipeline not found at configured path." if kind == "PATH_NOT_FOUND" else f"can't be read ({kind})", NAME) from problem
    if len(rows) != 1 or rows[0].model is None:
        raise ModelLoadError(f"{len(rows)} models in one place", NAME)
    if hashlib.sha256(rows[0].model.encode()).hexdigest() != rows[0].sha256:
        raise ModelLoadError("SHA-256 mismatch", NAME)
    try:
        found = json.loads(rows[0].model)
        model = Regressor(tuple(found["columns"]), int(found["base"]), tuple(Stump(str(f), float(e), int(lo), int(hi)) for f, e, lo, hi in found["stumps"]))
    except (KeyError, TypeError, ValueError) as problem:
        raise ModelLoadError(f"no model in it ({problem})", NAME) from problem
    if columns is not None and tuple(columns) != model.columns:
        raise ModelLoadError("it was fitted to other columns", NAME)
    return model


def with_saved_model(df: DataFrame, path: str, columns: Sequence[str] | None = MODEL_COLUMNS) -> DataFrame:
    """Adds ``raw_prediction``, ``model_error`` and ``prediction_error_type`` by the model saved at ``path``; if that can't be loaded, every row says so."""
    try:
        raw, error = load(df.sparkSession, path, columns).prediction(), None
    except ModelLoadError as problem:
        raw, error = F.lit(None).cast("double"), problem.reason
    kind = None if error is None else "ModelLoadError"
    return df.withColumns({"raw_prediction": raw, "model_error": F.lit(error).cast("string"), "prediction_error_type": F.lit(kind).cast("string")})
