"""Feature vectors and their validation, per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.errors import FeatureValidationError, message
from panelwright.functions.numeric import more_than, significant
from panelwright.operators.physics import lookup
from panelwright.settings import DEFAULT, DERIVED_COLUMNS, FEATURE_RANGES, MODEL_COLUMNS, Settings

RAW_COLUMNS = (*MODEL_COLUMNS, *DERIVED_COLUMNS)
# What the messages of invalid features say.
CONSISTENCY = "Numeric Consistency: Module temp anomalously high given near-zero irradiance."
MISSING_COLUMNS = "DataFrame is missing required columns: "
NAN_COLUMNS = "DataFrame contains NaN values in columns: "
OUT_OF_RANGE = "One or more feature values failed validation:\n"


def class_id(label: Column, s: Settings = DEFAULT) -> Column:
    """Index of the label; an unknown label has the index of the first."""
    return lookup(label, {x: float(i) for i, x in enumerate(s.labels)}, 0.0)


def with_features(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds ``fault_class_id`` and ``temperature_difference_c`` to rows with physics, and configured columns that are missing as 0."""
    df = df.withColumns(
        {
            "fault_class_id": class_id(F.col("label"), s),
            "temperature_difference_c": F.col("module_temp_c") - F.col("ambient_temp_c"),
        }
    )
    gaps = [c for c in s.model_columns if c not in df.columns]
    return df.withColumns({c: F.lit(0.0) for c in gaps}) if gaps else df


def missing_columns(columns: Sequence[str], s: Settings = DEFAULT) -> list[str]:
    """Required columns that aren't there, sorted: known when the plan is made."""
    return sorted(set(s.model_columns) - set(columns))


def _is_missing(name: str) -> Column:
    return F.col(name).isNull() | F.isnan(name)


def nan_columns(columns: Sequence[str]) -> Column:
    """Names of columns that are NaN or null in this row, in column order."""
    return F.filter(F.array(*[F.when(_is_missing(c), F.lit(c)) for c in columns]), lambda x: x.isNotNull())


def out_of_range(columns: Sequence[str]) -> Column:
    """Names of columns outside their inclusive range; infinities are, NaN counts too."""
    checks = [
        F.when(~F.coalesce(F.col(c).between(*FEATURE_RANGES[c]), F.lit(False)), F.lit(c))
        for c in FEATURE_RANGES
        if c in columns
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def inconsistent() -> Column:
    """A module much hotter than the air with hardly any light."""
    return (F.col("irradiance_wm2") < 10) & more_than(F.col("module_temp_c"), F.col("ambient_temp_c") + 15)


def violations(columns: Sequence[str]) -> Column:
    """All range violations, with the value to four digits, and the consistency message, in order and indented."""
    there = [c for c in FEATURE_RANGES if c in columns]
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in there])
    names = out_of_range(columns)
    ranged = F.transform(
        F.filter(each, lambda e: F.array_contains(names, e["name"])),
        lambda e: F.concat(F.lit("  '"), e["name"], F.lit("': "), significant(e["value"], 4), F.lit(" is outside "), F.element_at(_range_texts(), e["name"])),
    )
    none = F.array().cast("array<string>")
    return F.concat(F.when(F.size(names) > 0, ranged).otherwise(none), F.when(inconsistent(), F.array(F.lit("  " + CONSISTENCY))).otherwise(none))


def _range_texts() -> Column:
    return F.create_map(*[F.lit(x) for c, (lo, hi) in FEATURE_RANGES.items() for x in (c, f"[{lo}, {hi}]")])


def validated(df: DataFrame, columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """Adds ``nan_columns``, ``violations`` and ``feature_status`` (VALID, NAN or RANGE): missing values are told first."""
    return (
        df.withColumn("nan_columns", nan_columns(columns))
        .withColumn("violations", F.when(F.size("nan_columns") == 0, violations(columns)).otherwise(F.array().cast("array<string>")))
        .withColumn(
            "feature_status",
            F.when(F.size("nan_columns") > 0, "NAN").when(F.size("violations") > 0, "RANGE").otherwise("VALID"),
        )
    )


def feature_error() -> Column:
    """The reason why a validated row isn't valid: its missing columns, else its violations; null if it is valid."""
    missing = F.concat(F.lit(NAN_COLUMNS + "['"), F.array_join("nan_columns", "', '"), F.lit("']"))
    return F.when(F.col("feature_status") == "NAN", missing).when(
        F.col("feature_status") == "RANGE", F.concat(F.lit(OUT_OF_RANGE), F.array_join("violations", "\n"))
    )


def strict(df: DataFrame, columns: Sequence[str] = RAW_COLUMNS, s: Settings = DEFAULT) -> DataFrame:
    """Fails the job at the first invalid row with that row's message; at once if the model's columns aren't there."""
    if missing := missing_columns(df.columns, s):
        raise FeatureValidationError(MISSING_COLUMNS + str(missing))
    checked = validated(df, columns)
    error = message("FeatureValidationError", feature_error())
    return checked.where(F.when(F.col("feature_status") == "VALID", True).otherwise(F.raise_error(error).cast("boolean")))


def model_vector(df: DataFrame, s: Settings = DEFAULT, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Keys and the model's columns in their configured order."""
    return df.select(*keys, *s.model_columns)
