"""Irradiance, module temperature, soiling and losses, as columns.

Every step reads the rounded result of the one before. One ``withColumn`` a step: Catalyst merges
them into one projection, and no step's expression is written out twice by hand.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.numeric import clamp, floor_mod, larger, py_round
from panelwright.functions.plan import settled
from panelwright.settings import DEFAULT, Settings

LEAST_LATITUDE_FACTOR = 0.1


def cloud_factor(cloud_pct: Column) -> Column:
    """1 for a clear sky, 0 for a closed one; NaN stays NaN."""
    return py_round(F.lit(1.0) - clamp(cloud_pct, 0.0, 100.0) / F.lit(100.0), 4)


def wind_cooling(speed: Column, s: Settings = DEFAULT) -> Column:
    return py_round(F.lit(s.wind_cooling_coefficient) * speed, 2)


def irradiance(factor: Column, time: Column, latitude: Column, longitude: Column, s: Settings = DEFAULT) -> Column:
    """Seconds are ignored. Longitudes shift the solar hour by floor modulo; NaN coordinates give night or the least factor."""
    hour = F.hour(time) + F.minute(time) / F.lit(60.0)
    solar_hour = floor_mod(hour + longitude / F.lit(15.0), 24.0)
    sine = F.sin(F.lit(math.pi) * (solar_hour - F.lit(6.0)) / F.lit(12.0))
    height = larger(F.lit(0.0), sine) * larger(F.lit(LEAST_LATITUDE_FACTOR), F.cos(F.radians(latitude)))
    return py_round(F.lit(s.max_irradiance_wm2) * height * clamp(factor, 0.0, 1.0), 2)


def module_temperature(ambient: Column, irradiance_wm2: Column, cooling: Column, s: Settings = DEFAULT) -> Column:
    slope = (s.noct_celsius - s.noct_ambient_ref) / s.noct_irradiance_ref
    return py_round(ambient + F.lit(slope) * irradiance_wm2 - cooling, 2)


def lookup(label: Column, table: dict[str, float], default: float) -> Column:
    """A small table as a map literal: no join, no exchange. Case matters."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), label), F.lit(default))


def soiling_ratio(label: Column, s: Settings = DEFAULT) -> Column:
    return lookup(label, {k: float(v) for k, v in s.soiling.items()}, 1.0)


def temperature_loss(module_c: Column, s: Settings = DEFAULT) -> Column:
    """Per cent above the standard temperature; NaN gives 0."""
    change = F.lit(s.temp_coefficient_pmax) * (module_c - F.lit(s.stc_temperature)) * F.lit(100.0)
    return py_round(larger(F.lit(0.0), -change), 2)


def effective_efficiency(soiling: Column, loss_pct: Column) -> Column:
    return py_round(soiling * (F.lit(1.0) - loss_pct / F.lit(100.0)), 4)


def observed_at(time: Column, as_of: Column) -> Column:
    """A missing time is the run's ``as_of``, one for all rows."""
    return F.coalesce(time, as_of)


STEPS = (
    ("cloud_factor", lambda s: cloud_factor(F.col("cloud_cover_pct"))),
    ("wind_cooling_factor", lambda s: wind_cooling(F.col("wind_speed_ms"), s)),
    ("irradiance_wm2", lambda s: irradiance(F.col("cloud_factor"), F.col("observation_time"), F.col("latitude"), F.col("longitude"), s)),
    ("module_temp_c", lambda s: module_temperature(F.col("ambient_temp_c"), F.col("irradiance_wm2"), F.col("wind_cooling_factor"), s)),
    ("soiling_ratio", lambda s: soiling_ratio(F.col("label"), s)),
    ("temp_loss_pct", lambda s: temperature_loss(F.col("module_temp_c"), s)),
    ("effective_efficiency", lambda s: effective_efficiency(F.col("soiling_ratio"), F.col("temp_loss_pct"))),
)
PHYSICS_COLUMNS: Sequence[str] = tuple(name for name, _ in STEPS)


#: The earlier steps that a step reads.
READS = {
    "irradiance_wm2": ("cloud_factor",),
    "module_temp_c": ("cloud_factor", "irradiance_wm2", "wind_cooling_factor"),
    "temp_loss_pct": ("cloud_factor", "irradiance_wm2", "wind_cooling_factor", "module_temp_c"),
    "effective_efficiency": tuple(name for name, _ in STEPS[:-1]),
}


def with_physics(df: DataFrame, s: Settings = DEFAULT, columns: Sequence[str] = PHYSICS_COLUMNS) -> DataFrame:
    """Adds ``columns`` of PHYSICS_COLUMNS, and those they are made of, to observations; works on batch and streaming frames.

    The input is settled, as constant columns would else be written into every later step.
    """
    needed = {*columns, *(name for c in columns for name in READS.get(c, ()))}
    df = settled(df, "observations")
    for name, make in STEPS:
        if name in needed:
            df = df.withColumn(name, make(s))
    return df
