"""Golden values of the physics steps."""

import datetime as dt
import math

import pytest
from panelwright.operators import physics as P
from pyspark.sql import functions as F

NOON = dt.datetime(2026, 7, 14, 12)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("cloud", "factor"), [(0.0, 1.0), (50.0, 0.5), (90.0, 0.1), (100.0, 0.0), (33.33, 0.6667), (-100.0, 1.0), (200.0, 0.0)])
def test_cloud_factor(spark, cloud, factor):
    assert value(spark, P.cloud_factor(F.lit(cloud))) == factor


@pytest.mark.parametrize(("wind", "cooling"), [(0.01, 0.01), (0.03, 0.04), (3.23, 4.84), (5.55, 8.32), (0.05, 0.08), (0.23, 0.35), (3.21, 4.81), (-2.0, -3.0)])
def test_wind_cooling(spark, wind, cooling):
    assert value(spark, P.wind_cooling(F.lit(wind))) == cooling


@pytest.mark.parametrize(
    ("hour", "lat", "lon", "watts"),
    [(12, 0, 0, 1000.0), (9, 0, 0, 707.11), (15, 0, 0, 707.11), (7, 0, 0, 258.82), (6, 0, 0, 0.0), (0, 0, 0, 0.0), (12, 60, 0, 500.0), (12, 90, 0, 100.0),
     (12, 0, 15, 965.93), (12, 0, -15, 965.93), (12, 0, 180, 0.0), (12, 0, -180, 0.0), (12, math.nan, 0, 100.0), (12, 0, math.nan, 0.0)],
)
def test_irradiance(spark, hour, lat, lon, watts):
    time = F.lit(NOON.replace(hour=hour, second=59).isoformat()).cast("timestamp_ntz")
    assert value(spark, P.irradiance(F.lit(1.0), time, F.lit(float(lat)), F.lit(float(lon)))) == watts


@pytest.mark.parametrize(("ambient", "watts", "cooling", "module"), [(25, 0, 0, 25.0), (25, 0, 3, 22.0), (25, 800, 0, 50.0), (20, 800, 0, 45.0)])
def test_module_temperature(spark, ambient, watts, cooling, module):
    assert value(spark, P.module_temperature(*(F.lit(float(x)) for x in (ambient, watts, cooling)))) == module


@pytest.mark.parametrize(("label", "ratio"), [("Clean", 1.0), ("Dusty", 0.92), ("Bird-Drop", 0.88), ("Electrical-Damage", 0.8), ("Physical-Damage", 0.75), ("Hotspot", 0.7), ("Unknown", 1.0), ("dusty", 1.0), ("", 1.0), (None, 1.0)])
def test_soiling(spark, label, ratio):
    assert value(spark, P.soiling_ratio(F.lit(label).cast("string"))) == ratio


@pytest.mark.parametrize(("module", "loss"), [(25.0, 0.0), (50.0, 10.0), (15.0, 0.0), (math.nan, 0.0)])
def test_temperature_loss(spark, module, loss):
    assert value(spark, P.temperature_loss(F.lit(module))) == loss


CASES = [
    ((25.0, 2.0, 0.0, "Clean", 0.0, 0.0, 12), (1.0, 3.0, 1000.0, 53.25, 1.0, 11.3, 0.887)),
    ((25.0, 2.0, 0.0, "Dusty", 0.0, 0.0, 12), (1.0, 3.0, 1000.0, 53.25, 0.92, 11.3, 0.816)),
    ((25.0, 2.0, 0.0, "Clean", 0.0, 0.0, 0), (1.0, 3.0, 0.0, 22.0, 1.0, 0.0, 1.0)),
    ((25.0, 2.0, 30.0, "Clean", 13.08, 80.27, 6), (0.7, 3.0, 672.03, 43.0, 1.0, 7.2, 0.928)),
    ((18.0, 2.0, 90.0, "Clean", 13.08, 80.27, 4), (0.1, 3.0, 74.91, 17.34, 1.0, 0.0, 1.0)),
    ((42.0, 1.0, 10.0, "Clean", 13.08, 80.27, 4), (0.9, 1.5, 674.2, 61.57, 1.0, 14.63, 0.8537)),
]


def test_composition(spark):
    rows = [(i, *c[:6], NOON.replace(hour=c[6])) for i, (c, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "run_id int, ambient_temp_c double, wind_speed_ms double, cloud_cover_pct double, label string, latitude double, longitude double, observation_time timestamp_ntz")
    got = P.with_physics(df).orderBy("run_id").select(*P.PHYSICS_COLUMNS).collect()
    assert [tuple(r) for r in got] == [want for _, want in CASES]


def test_plan_is_one_stage_without_exchange(spark):
    df = spark.range(10).selectExpr("id run_id", "20.0D ambient_temp_c", "1.0D wind_speed_ms", "10.0D cloud_cover_pct", "'Clean' label", "0.0D latitude", "0.0D longitude", "timestamp_ntz'2026-07-14 12:00:00' observation_time")
    plan = P.with_physics(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
