"""The driver's tables as domain rows: integer arithmetic and single IEEE operations, so exact in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.settings import LABELS
from panelwright.sources.images import encoded

OBSERVED_LABELS = (*LABELS, "Unknown", "dusty")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _observation() -> list[Column]:
    """From a row of ``events`` and its ``nation``."""
    n = F.col("n_nationkey")
    e = F.col("event_id")
    labels = F.array(*[F.lit(x) for x in OBSERVED_LABELS])
    return [
        e.alias("run_id"),
        F.col("ts").alias("observation_time"),
        F.col("n_name").alias("city"),
        (n * 7 % 181 - 90).cast("double").alias("latitude"),
        (n * 29 % 361 - 180).cast("double").alias("longitude"),
        (F.col("value") - 50).alias("cloud_cover_pct"),
        ((e % 2001).cast("double") / F.lit(100.0)).alias("wind_speed_ms"),
        ((e * 37 % 600).cast("double") / F.lit(10.0) - F.lit(10.0)).alias("ambient_temp_c"),
        F.get_json_object("props", "$.k").cast("double").alias("humidity_pct"),
        F.get(labels, (e % 8).cast("int")).alias("label"),
        ((e % 101).cast("double") / F.lit(100.0)).alias("detection_confidence"),
    ]


def _scalars() -> list[Column]:
    """From a row of ``events``: run inputs with all kinds of faults."""
    e = F.col("event_id")
    types = F.array(*[F.lit(x) for x in ("rooftop", "ground-mount", "carport", "floating", "", "  ", "wall")])
    return [
        ((e % 131).cast("double") - F.lit(5.0)).alias("panel_age"),
        (e % 61 - 2).alias("maintenance_count"),
        F.when(e % 97 == 0, F.lit(float("nan"))).otherwise((e % 1203).cast("double") - F.lit(3.0)).alias("voltage"),
        F.when(e % 89 == 0, F.lit(float("inf"))).otherwise((e % 127).cast("double") - F.lit(1.0)).alias("current"),
        F.get(types, (e % 7).cast("int")).alias("installation_type"),
    ]


def observed(events: DataFrame, nation: DataFrame) -> DataFrame:
    """Observations from ``events``; a city's coordinates from ``nation``. Batch or streaming events."""
    return events.join(nation, F.col("n_nationkey") == F.col("event_id") % 25).select(*_observation())


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(table(spark, sf_dir, "events"), table(spark, sf_dir, "nation"))


def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), *_scalars())


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with run inputs, both from the same pass over ``events``."""
    events, nation = table(spark, sf_dir, "events"), table(spark, sf_dir, "nation")
    return events.join(nation, F.col("n_nationkey") == F.col("event_id") % 25).select(*_observation(), *_scalars())


def logits(spark: SparkSession, sf_dir: str, n: int = 6) -> DataFrame:
    """The first ``n`` numbers of each embedding as class logits."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("run_id"),
        F.transform(F.slice("embedding", 1, n), lambda x: x.cast("double")).alias("logits"),
        F.col("label").alias("true_label"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes of their order's image."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").alias("ord"),
        F.array(F.lit(0.0), F.lit(0.0), F.col("l_quantity"), F.col("l_extendedprice")).alias("box"),
        F.col("l_discount").alias("confidence"),
        (F.col("l_suppkey") % 3).cast("int").alias("class_id"),
    )


#: Sides of the images, colour types with their samples a pixel, and the palette of the third.
SIDES = ((55, 71, 83, 16, 64, 90), (71, 55, 64, 83, 30, 16))
PNG_KINDS = ((0, 1), (2, 3), (3, 1), (4, 2), (6, 4))
PALETTE = bytes(v for i in range(256) for v in (i, 255 - i, i * 7 % 256))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as PNG images (``run_id``, ``content``) of many sides, of all colour types and filters, some damaged in five ways."""
    k = F.col("vec_id")
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    made = table(spark, sf_dir, "embeddings").select(
        k.alias("run_id"),
        pick(SIDES[0], k % 6).alias("width"),
        pick(SIDES[1], F.floor(k / 6) % 6).alias("height"),
        pick([c for c, _ in PNG_KINDS], k % 5).alias("colour"),
        pick([n for _, n in PNG_KINDS], k % 5).alias("channels"),
        F.when(k % 5 == 2, F.lit(PALETTE)).alias("palette"),
        F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000)).alias("values"),
        (k % 5).cast("int").alias("first_filter"),
    )
    place = F.sequence(F.lit(0), F.col("width") * F.col("height") * F.col("channels") - 1)
    made = made.withColumn("samples", F.transform(place, lambda i: ((F.get("values", i % 64) + i * 7 + F.col("run_id")) % 256).cast("int")))
    done = encoded(made)
    c, size = F.col("content"), F.length("content")
    # a byte of the second chunk's name
    flipped = F.unhex(F.concat(F.hex(F.substring(c, 1, 40)), F.lit("00"), F.hex(c.substr(F.lit(42), size - 41))))
    return done.select(
        "run_id",
        F.when(F.col("run_id") % 11 == 0, F.lit(None).cast("binary")).when(F.col("run_id") % 11 == 1, F.lit(b""))
        .when(F.col("run_id") % 11 == 2, c.substr(F.lit(1), F.floor(size / 2).cast("int")))
        .when(F.col("run_id") % 11 == 3, flipped)
        .when(F.col("run_id") % 11 == 4, F.lit(b"not_an_image_at_all")).otherwise(c).alias("content"),
    )


def raw_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a detector's raw output, one row an image (order): lists of boxes that overlap a lot, confidences, class ids."""
    p, q = F.col("l_partkey"), F.col("l_suppkey")
    x, y = (q % 4 * 10).cast("double"), (p % 4 * 10).cast("double")
    one = F.struct(
        F.col("l_linenumber").alias("ord"),
        F.array(x, y, x + F.col("l_quantity") + 40.0, y + (p % 50).cast("double") + 40.0).alias("box"),
        ((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17 + p) % 100 / F.lit(100.0)).alias("confidence"),
        (q % 2).cast("int").alias("class_id"),
    )
    images = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.array_sort(F.collect_list(one)).alias("b"))
    return images.select("run_id", F.col("b.box").alias("boxes"), F.col("b.confidence").alias("confidences"), F.col("b.class_id").alias("class_ids"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather payloads, good and malformed in ten ways."""
    e = F.col("event_id")
    k = e % 12
    temp = (e * 37 % 600).cast("double") / F.lit(10.0) - F.lit(10.0)
    main = F.concat(
        F.lit('"main":{"temp":'),
        F.when(k == 1, F.lit('"hot"')).when(k == 2, F.lit("null")).when(k == 3, F.concat(F.lit('"'), temp.cast("string"), F.lit('"'))).otherwise(temp.cast("string")),
        F.lit(',"humidity":'), (e % 101).cast("string"), F.lit(',"pressure":'), (F.lit(950) + e % 100).cast("string"), F.lit("}"),
    )
    body = F.concat(
        F.when(k == 4, "").otherwise(F.concat(F.lit('"name":"Station '), (e % 50).cast("string"), F.lit('",'))),
        main,
        F.lit(',"wind":{"speed":'), (e % 40).cast("string"), F.lit('},"clouds":{"all":'), (e % 101).cast("string"),
        F.lit('},"coord":{"lat":'), (e % 181 - 90).cast("string"), F.lit(',"lon":'), (e % 361 - 180).cast("string"), F.lit("},"),
        F.when(k == 5, "").otherwise(F.concat(F.lit('"dt":'), (F.lit(1697904000) + e * 60).cast("string"), F.lit(","))),
        F.when(k == 6, F.lit('"weather":[]')).otherwise(F.concat(F.lit('"weather":[{"description":"sky '), (e % 9).cast("string"), F.lit('"}]'))),
    )
    return table(spark, sf_dir, "events").select(
        e.alias("run_id"),
        F.when(k == 7, F.lit("")).when(k == 8, F.lit("a\tb")).otherwise(F.concat(F.lit(" City "), (e % 30).cast("string"), F.lit(" "))).alias("city"),
        F.when(k == 9, F.lit("{}")).when(k == 10, F.lit("[1]")).otherwise(F.concat(F.lit("{"), body, F.lit("}"))).alias("payload"),
    )


def weather_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as runs (``run_id``, ``city``, ``at``), and those of type ``view`` as weather observations of their city, too."""
    e, n = F.col("event_id"), F.col("n_nationkey")
    events = table(spark, sf_dir, "events").join(table(spark, sf_dir, "nation"), n == e % 25)
    at = F.col("ts").cast("timestamp").alias("at")
    runs = events.select(e.alias("run_id"), F.when(e % 97 != 0, F.col("n_name")).alias("city"), at)
    names = ("ambient_temp_c", "humidity_pct", "wind_speed_ms", "cloud_cover_pct", "pressure_hpa", "latitude", "longitude")
    values = [(e % (41 + 2 * i)).cast("double").alias(c) for i, c in enumerate(names)]
    return runs, events.where("event_type = 'view'").select(F.col("n_name").alias("city"), at, e.alias("event_id"), *values)


def recorded_answer(request) -> str:
    """What the weather service said of a city, made of its name: one fails once, one always, one sends nothing of use."""
    n = len(request.city)
    if request.city.startswith("I") or (request.city.startswith("A") and not request.attempt):
        raise TimeoutError
    if request.city.startswith("U"):
        return "{}"
    return (
        f'{{"name": "{request.city}", "main": {{"temp": {n * 1.25}, "humidity": {n * 3}, "pressure": {1000 + n}}}, "wind": {{"speed": {n * 0.5}}}, '
        f'"clouds": {{"all": {n * 4}}}, "coord": {{"lat": {n - 10}, "lon": {n * 7}}}, "dt": {1700000000 + n}, "weather": [{{"description": "clear"}}]}}'
    )


def raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with controls, white space of several kinds, blanks, and long ones."""
    e = F.col("event_id")
    k = e % 9
    n = e.cast("string")
    return table(spark, sf_dir, "events").select(
        e.alias("run_id"),
        F.when(k == 0, F.concat(F.lit("  City\t"), n, F.lit("\n")))
        .when(k == 1, F.concat(F.lit("　São Paulo "), n, F.lit("　")))
        .when(k == 2, F.lit("   "))
        .when(k == 3, F.repeat(F.concat(F.lit("A"), n), 60))
        .when(k == 4, F.lit(""))
        .when(k == 5, F.concat(F.lit("a\x7fb"), n))
        .when(k == 6, F.lit(None))
        .when(k == 7, F.concat(F.lit("../../"), n, F.lit("; rm   -rf /")))
        .otherwise(F.concat(F.lit("Chennai "), n)).alias("raw"),
    )
