"""Loss predictions: the interface for models, and what their outputs must satisfy.

No trained weights come with this library. ``surrogate_loss`` is a stand-in made of the physics
columns, for tests and demonstrations; it is not a trained model and isn't presented as one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.errors import ModelLoadError
from panelwright.functions.numeric import clamp, finite
from panelwright.operators.models import Model, each_row
from panelwright.settings import DEFAULT, Settings


class Predictor(Protocol):
    """Takes a pandas frame with the model's columns in order, returns one loss per row."""

    def predict(self, features): ...


def surrogate_loss(efficiency: Column) -> Column:
    """NOT a trained model: the loss that the effective efficiency itself stands for."""
    return F.lit(100.0) * (F.lit(1.0) - efficiency)


def output_error(raw: Column) -> Column:
    return F.when(raw.isNull(), "Invalid prediction output").when(~finite(raw), "Prediction output must be finite")


def with_prediction(df: DataFrame, raw: Column, s: Settings = DEFAULT, error: Column | None = None) -> DataFrame:
    """Adds ``prediction_error``, ``efficiency_loss_pct`` (0 to 100), ``estimated_output_w``, ``prediction_successful``.

    ``error`` is what the model itself says of a row.
    """
    return (
        df.withColumn("_raw", raw)
        .withColumn("prediction_error", F.coalesce(*([error] if error is not None else []), output_error(F.col("_raw"))))
        .withColumn("prediction_successful", F.col("prediction_error").isNull())
        .withColumn("efficiency_loss_pct", F.when(F.col("prediction_successful"), clamp(F.col("_raw"), 0.0, 100.0)).otherwise(0.0))
        .withColumn(
            "estimated_output_w",
            F.when(
                F.col("prediction_successful"),
                F.lit(s.panel_rated_power_wp) * (F.lit(1.0) - F.col("efficiency_loss_pct") / F.lit(100.0)),
            ).otherwise(0.0),
        )
        .drop("_raw")
    )


def predicted(df: DataFrame, load: Callable[[], Predictor] | Model | None, s: Settings = DEFAULT, key: str = "run_id") -> DataFrame:
    """``key``, ``raw_prediction``, ``error_type`` and ``error`` by a model over Arrow batches.

    ``load`` runs on the workers, once a process. If it fails, every row has a ModelLoadError; a row on which the model fails, or
    whose output is no number, has a PredictionError, and no other row suffers from it.
    """
    model = load if isinstance(load, Model) else Model("XGBoost", load)
    columns = list(s.model_columns)

    def number(value) -> tuple[float | None, str | None]:
        try:
            return float(value), None
        except (TypeError, ValueError) as problem:
            return None, f"Invalid prediction output: {problem}"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            frame = pa.Table.from_batches([batch]).select(columns).to_pandas()
            try:
                predictor = model.get()
                found = [(None, error) if error else number(x) for x, error in each_row(predictor.predict, frame)]
                kind = "PredictionError"
            except ModelLoadError as problem:
                found, kind = [(None, problem.reason)] * len(frame), "ModelLoadError"
            raw, errors = ([f[i] for f in found] for i in (0, 1))
            kinds = [kind if e is not None else None for e in errors]
            yield pa.record_batch(
                [batch.column(0), pa.array(raw, pa.float64()), pa.array(kinds, pa.string()), pa.array(errors, pa.string())],
                [key, "raw_prediction", "error_type", "error"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *columns).mapInArrow(run, f"{key} {kind}, raw_prediction double, error_type string, error string")
