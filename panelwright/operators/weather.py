"""Weather payloads to records, with all-or-nothing defaults, and their join to runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.text import valid_city
from panelwright.schemas import WEATHER_PAYLOAD
from panelwright.settings import DEFAULT, Settings

#: field: path in the payload. Leaves are read as text, as quoted numbers count as numbers.
PATHS = {
    "ambient_temp_c": "main.temp",
    "humidity_pct": "main.humidity",
    "wind_speed_ms": "wind.speed",
    "cloud_cover_pct": "clouds.all",
    "pressure_hpa": "main.pressure",
    "latitude": "coord.lat",
    "longitude": "coord.lon",
}
#: Seconds for which an observation stands for the weather of its city.
LIFETIME_S = 3 * 3600
#: Seconds since 1970 that a timestamp may have (year 9999).
MOST_SECONDS = 253402300799


def number(text: Column) -> Column:
    return text.try_cast("double")


def parsed(df: DataFrame, payload: str = "payload", city: str = "city", s: Settings = DEFAULT) -> DataFrame:
    """Adds a ``weather`` struct and two flags.

    ``degraded``: the city is invalid, or a field is missing or no number; then every value is its
    default, the city the validated one (or, if it is invalid, the one given), the time null.
    ``crashed``: a valid payload otherwise, but with an empty ``weather`` list, or no object at all,
    or a time out of range; such runs fail instead of going on with defaults.
    """
    p = F.from_json(F.col(payload), WEATHER_PAYLOAD)
    seconds = number(F.col("_p.dt"))
    values = {name: number(F.col(f"_p.{path}")) for name, path in PATHS.items()}
    complete = F.lit(True)
    for v in values.values():
        complete = complete & v.isNotNull()
    in_range = F.abs(seconds) <= MOST_SECONDS
    clean = F.col("_clean")
    listed = F.col("_p.weather").isNotNull()
    empty_list = listed & (F.size("_p.weather") == 0)
    is_array = F.coalesce(F.col(payload).rlike("^\\s*\\["), F.lit(False)) & clean.isNotNull()
    fields_ok = F.coalesce(clean.isNotNull() & complete & seconds.isNotNull(), F.lit(False))
    crashed = F.coalesce(is_array | (fields_ok & (empty_list | ~in_range)), F.lit(False))
    ok = fields_ok & ~crashed & F.coalesce(F.get("_p.weather", F.lit(0))["description"].isNotNull(), F.lit(False))
    defaults = s.weather_defaults
    filled = [F.when(F.col("_ok"), v).otherwise(F.lit(float(defaults[n]))).alias(n) for n, v in values.items()]
    return (
        df.withColumns({"_p": p, "_clean": valid_city(F.col(city))})
        .withColumns({"_ok": ok, "crashed": crashed})
        .withColumn(
            "weather",
            F.struct(
                F.when(F.col("_ok"), F.coalesce("_p.name", clean)).otherwise(F.coalesce(clean, F.col(city))).alias("city"),
                *filled,
                F.when(F.col("_ok"), F.timestamp_seconds(seconds.cast("long"))).alias("timestamp"),
                F.when(F.col("_ok"), F.get("_p.weather", F.lit(0))["description"]).otherwise("").alias("description"),
                F.col("_ok").alias("fetch_successful"),
            ),
        )
        .withColumn("degraded", ~F.col("_ok") & ~F.col("crashed"))
        .drop("_p", "_clean", "_ok")
    )


def attached(runs: DataFrame, weather: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Runs with the weather of their city (``weather``: ``city`` and the fields); runs without one get the defaults.

    One row per run: of several rows of a city the smallest counts. Spark broadcasts the weather if
    it is measured to be small enough, and else joins by sorting.
    """
    per_city = weather.groupBy("city").agg(F.min(F.struct(*PATHS)).alias("w"))
    city = valid_city(F.col("city"))
    return (
        runs.withColumn("_city", city)
        .join(per_city.withColumnRenamed("city", "_of"), F.col("_city") == F.col("_of"), "left")
        .withColumns({n: F.coalesce(F.col(f"w.{n}"), F.lit(float(s.weather_defaults[n]))) for n in PATHS})
        .withColumn("fetch_successful", F.col("w").isNotNull())
        .drop("_city", "_of", "w")
    )


def as_of(runs: DataFrame, observations: DataFrame, lifetime_s: int = LIFETIME_S, s: Settings = DEFAULT) -> DataFrame:
    """Runs (``run_id``, ``city``, ``at``) with the latest weather of their city up to then, if it isn't older than ``lifetime_s``.

    ``observations`` has ``city``, ``at`` and the fields. Of several at one time the smallest counts; runs without one, or without
    city or time, get the defaults. Time is cut into spans of a lifetime: a run looks into its own and the one before, to which end an
    observation is there twice. So a city's rows are spread over as many tasks as there are spans, and each streams through one sort.
    """
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    span = F.floor(micros / F.lit(lifetime_s * 1_000_000))
    fields = F.struct(*[F.col(c).cast("double").alias(c) for c in PATHS])
    none = F.lit(None)
    seen = observations.where("city is not null and at is not null").select(
        "city", F.explode(F.array(span, span + 1)).alias("span"), micros.alias("us"), F.lit(0).alias("kind"), none.cast("long").alias("run_id"), fields.alias("w")
    )
    # what can't have weather isn't gathered in one place
    asked = runs.select(
        "city", F.when(F.col("city").isNull() | F.col("at").isNull(), F.xxhash64("run_id")).otherwise(span).alias("span"), micros.alias("us"),
        F.lit(1).alias("kind"), F.col("run_id").cast("long").alias("run_id"), none.cast(seen.schema["w"].dataType).alias("w"),
    )
    order = Window.partitionBy("city", "span").orderBy("us", "kind", F.col("w").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.last(F.when(F.col("kind") == 0, F.struct("us", "w")), ignorenulls=True).over(order)
    both = seen.union(asked).withColumn("latest", latest).where("kind = 1")
    fresh = F.col("latest.us") >= F.col("us") - F.lit(lifetime_s * 1_000_000)
    return both.select("run_id", "city", F.when(fresh, F.col("latest.w")).alias("w")).select(
        "run_id", "city", *[F.coalesce(F.col(f"w.{n}"), F.lit(float(s.weather_defaults[n]))).alias(n) for n in PATHS], F.col("w").isNotNull().alias("fetch_successful")
    )
