"""Summaries and weather over whole tables, with images that have no boxes and cities that have no weather."""

from panelwright.operators import vision, weather
from panelwright.plans.queries import QUERIES
from pyspark.sql import functions as F


def test_every_box_counts(spark, sf_dir):
    boxes = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    got = QUERIES["detection_summary_all"](spark, sf_dir)
    assert got.agg(F.sum("panel_count")).first()[0] == boxes and got.where("best_confidence >= 0.05").count() > 0


def test_every_city_has_weather(spark, sf_dir):
    names = {r.n_name for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()}
    got = QUERIES["weather_join_all"](spark, sf_dir).where("fetch_successful").select("city").distinct()
    assert {r.city for r in got.collect()} & names == {r.city for r in QUERIES["weather_join_all"](spark, sf_dir).select("city").distinct().collect()} & names


def test_image_without_boxes(spark):
    runs = spark.createDataFrame([(1,), (2,)], "run_id long")
    boxes = spark.createDataFrame([(1, k, 0.1 * k) for k in range(1, 10)], "run_id long, ord int, confidence double")
    got = {r.run_id: tuple(r)[1:] for r in vision.detection_summary(runs, boxes).collect()}
    assert got == {1: (9, 0.9, True), 2: (0, 0.0, False)}


def test_city_without_weather(spark):
    names = ", ".join(f"{n} double" for n in weather.PATHS)
    found = spark.createDataFrame([("Paris", *[7.0] * len(weather.PATHS))], f"city string, {names}")
    runs = spark.createDataFrame([(1, "Paris"), (2, "Oslo")], "run_id long, city string")
    got = {r.run_id: (r.fetch_successful, r.pressure_hpa) for r in weather.attached(runs, found).collect()}
    assert got == {1: (True, 7.0), 2: (False, 1013.25)}
