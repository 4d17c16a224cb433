"""Checks of the scalars that come with a run: the first failure counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.numeric import finite, significant
from panelwright.functions.text import not_blank
from panelwright.settings import MOUNT_TYPES

#: What the form accepts: narrower than what a run does.
UI_BOUNDS = {"panel_age": (0.0, 40.0), "maintenance_count": (0, 50), "voltage": (0.0, 1000.0), "current": (0.0, 100.0)}
TYPE_MESSAGE = "'installation_type' must be a non-empty string (e.g. 'rooftop' or 'ground-mount')."


def input_error() -> Column:
    """Message for ``panel_age``, ``maintenance_count``, ``voltage``, ``current``, ``installation_type``, with the value; null if all are fine."""
    age, count, volts, amps = (F.col(c) for c in ("panel_age", "maintenance_count", "voltage", "current"))

    def number(name: str) -> list[tuple[Column, Column]]:
        return [
            (F.col(name).isNull(), F.lit(f"'{name}' must be a number, got NoneType.")),
            (~finite(F.col(name)), F.lit(f"'{name}' must be a finite number.")),
        ]

    def got(text: str, value: Column) -> Column:
        return F.concat(F.lit(f"{text}, got "), value, F.lit("."))

    checks = [
        *number("panel_age"),
        (~age.between(0.0, 100.0), got("'panel_age' must be between 0 and 100 years", significant(age, 6))),
        (count.isNull(), F.lit("'maintenance_count' must be an integer, got NoneType.")),
        (count < 0, got("'maintenance_count' must be >= 0", count.cast("string"))),
        *number("voltage"),
        (volts < 0, got("'voltage' must be >= 0 V", significant(volts, 6))),
        *number("current"),
        (amps < 0, got("'current' must be >= 0 A", significant(amps, 6))),
        (~not_blank(F.col("installation_type")), F.lit(TYPE_MESSAGE)),
    ]
    found = F
    for bad, text in checks:
        found = found.when(bad, text)
    return found.otherwise(None)


def with_input_error(df: DataFrame) -> DataFrame:
    return df.withColumn("input_error", input_error())


def within_ui_bounds() -> Column:
    ok = F.col("installation_type").isin(*MOUNT_TYPES)
    for name, (low, high) in UI_BOUNDS.items():
        ok = ok & F.col(name).between(low, high)
    return F.coalesce(ok, F.lit(False))
