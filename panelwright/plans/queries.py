"""The registered queries: each a plan over the driver's tables. Their SQL is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions import text
from panelwright.functions.arrays import argmax, by_label, label_of, normalised, probability_error, softmax
from panelwright.functions.metrics import RunMetrics
from panelwright.functions.numeric import finite, fixed, percent, py_round
from panelwright.functions.plan import settled
from panelwright.functions.shared import work_dir
from panelwright.operators import artifacts, features, inputs, physics, prediction, regression, rules, vision, weather
from panelwright.plans import pipeline
from panelwright.settings import DEFAULT, IMAGE_MEAN, IMAGE_STD, LABELS, Settings
from panelwright.sources import adapters, images
from panelwright.sources.weather_source import weather_of

Query = Callable[[SparkSession, str], DataFrame]
#: Sizes at which SQL can still resample: the detector's and the classifier's square.
THUMBNAILS = (24, 16)
#: Parts in which a log is replayed; the stream is started anew for each.
LOG_PARTS = 4
PLACES = 9  # of floats that depend on the platform's exp or division order


def _physics(spark: SparkSession, d: str) -> DataFrame:
    return physics.with_physics(adapters.observations(spark, d))


def _features(spark: SparkSession, d: str) -> DataFrame:
    return settled(features.with_features(_physics(spark, d)), "features")


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    loss = prediction.surrogate_loss(F.col("effective_efficiency"))
    return settled(prediction.with_prediction(_features(spark, d), loss), "predictions")


def _advised(spark: SparkSession, d: str) -> DataFrame:
    return settled(rules.with_report(_predicted(spark, d)), "reports")


def _faulty(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows with missing values, faults in every column, and inconsistent temperatures."""
    e = F.col("run_id")
    changed = _features(spark, d).withColumns(
        {
            "humidity_pct": F.when(e % 41 == 0, F.lit(float("nan"))).otherwise(F.col("humidity_pct") + F.when(e % 43 == 0, 200.0).otherwise(0.0)),
            "detection_confidence": F.when(e % 47 == 0, F.lit(None).cast("double")).when(e % 53 == 0, F.lit(float("inf"))).otherwise(F.col("detection_confidence")),
            "module_temp_c": F.when(e % 7 == 0, F.col("ambient_temp_c") + 15 + (e % 3 - 1)).otherwise(F.col("module_temp_c")),
            "cloud_cover_pct": py_round(F.col("cloud_cover_pct"), 2),
        }
    )
    return settled(changed, "faulty")


def _validated(spark: SparkSession, d: str) -> DataFrame:
    return settled(features.validated(_faulty(spark, d)), "validated")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return vision.classified(adapters.logits(spark, d))


def _rounded(values: Column, places: int = 6) -> Column:
    return F.transform(values, lambda x: py_round(x, places))


def _raw_outputs(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return adapters.table(spark, d, "events").select(
        e.alias("run_id"),
        F.when(e % 17 == 0, F.lit(float("nan"))).when(e % 19 == 0, F.lit(float("inf"))).when(e % 23 == 0, F.lit(None).cast("double"))
        .otherwise((e % 141).cast("double") - F.lit(20.0)).alias("raw"),
    )


def _rule(make: Callable[[], Column]) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _predicted(spark, d).select("run_id", make().alias("f")).where("f is not null").select("run_id", "f.severity", "f.message", "f.action")

    return query


def _column(*columns: str, of: Query) -> Query:
    return lambda spark, d: of(spark, d).select("run_id", *columns)


def _steps(*columns: str) -> Query:
    return lambda spark, d: physics.with_physics(adapters.observations(spark, d), columns=columns).select("run_id", *columns)


def soiling_ratio(spark: SparkSession, d: str) -> DataFrame:
    return adapters.observations(spark, d).select("label", physics.soiling_ratio(F.col("label")).alias("soiling_ratio")).distinct()


def as_of_default(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth time is missing and becomes the run's."""
    as_of = F.lit("2024-06-01 10:30:00").cast("timestamp_ntz")
    df = adapters.observations(spark, d).withColumn("observation_time", F.when(F.col("run_id") % 5 != 0, F.col("observation_time").cast("timestamp_ntz")))
    df = df.withColumn("observation_time", physics.observed_at(F.col("observation_time"), as_of))
    return physics.with_physics(df, columns=("irradiance_wm2",)).select("run_id", "irradiance_wm2", F.hour("observation_time").alias("hour"))


def feature_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    s = Settings(model_columns=(*DEFAULT.model_columns, "panel_tilt", "panel_azimuth"))
    return features.model_vector(features.with_features(_physics(spark, d), s), s)


def validate_nan(spark: SparkSession, d: str) -> DataFrame:
    return _validated(spark, d).where("feature_status = 'NAN'").select("run_id", F.array_join("nan_columns", ",").alias("nan_columns"))


def validate_ranges(spark: SparkSession, d: str) -> DataFrame:
    found = features.out_of_range(features.RAW_COLUMNS)
    return _faulty(spark, d).select("run_id", F.array_join(found, ",").alias("out_of_range")).where("out_of_range <> ''")


def validate_consistency(spark: SparkSession, d: str) -> DataFrame:
    return _faulty(spark, d).where(features.inconsistent()).select("run_id", "irradiance_wm2", "module_temp_c", "ambient_temp_c")


def validation_report(spark: SparkSession, d: str) -> DataFrame:
    return _validated(spark, d).groupBy("feature_status").agg(F.count("*").alias("n"), F.sum(F.size("violations")).alias("n_violations"))


def feature_errors(spark: SparkSession, d: str) -> DataFrame:
    return _validated(spark, d).where("feature_status <> 'VALID'").select("run_id", "feature_status", features.feature_error().alias("message"))


def input_validation(spark: SparkSession, d: str) -> DataFrame:
    return inputs.with_input_error(adapters.scalars(spark, d)).select("run_id", F.coalesce("input_error", F.lit("")).alias("input_error"))


def finite_check(spark: SparkSession, d: str) -> DataFrame:
    return adapters.scalars(spark, d).agg(
        *[F.count_if(~finite(F.col(c))).alias(f"bad_{c}") for c in ("panel_age", "voltage", "current")]
    )


def default_city(spark: SparkSession, d: str) -> DataFrame:
    return adapters.raw_texts(spark, d).select("run_id", text.default_if_empty(F.col("raw"), DEFAULT.default_city).alias("city"))


def ui_bounds(spark: SparkSession, d: str) -> DataFrame:
    return adapters.scalars(spark, d).where(inputs.within_ui_bounds()).select("run_id", "panel_age", "installation_type")


def _text_query(make: Callable[[Column], Column], name: str) -> Query:
    return lambda spark, d: adapters.raw_texts(spark, d).select("run_id", make(F.col("raw")).alias(name))


def weather_parse(spark: SparkSession, d: str) -> DataFrame:
    w = settled(weather.parsed(adapters.payloads(spark, d)), "weather").where("weather.fetch_successful")
    return w.select("run_id", *[f"weather.{c}" for c in ("city", *weather.PATHS, "description")], F.unix_timestamp("weather.timestamp").alias("observed_s"))


def weather_fallback(spark: SparkSession, d: str) -> DataFrame:
    return weather.parsed(adapters.payloads(spark, d)).select(
        "run_id", "degraded", "crashed", F.coalesce("weather.city", F.lit("")).alias("weather_city"), "weather.ambient_temp_c", "weather.pressure_hpa"
    )


def _joined_weather(spark: SparkSession, d: str, cities: DataFrame) -> DataFrame:
    n = F.col("n_nationkey")
    found = cities.select(
        F.col("n_name").alias("city"), (n * 1.5).alias("ambient_temp_c"), (n * 3.0).alias("humidity_pct"), (n * 0.25).alias("wind_speed_ms"),
        (n * 4.0).alias("cloud_cover_pct"), (n + 1000.0).alias("pressure_hpa"), (n - 12.0).alias("latitude"), (n * 7.0).alias("longitude"),
    )
    runs = adapters.observations(spark, d).select("run_id", "city", "label")
    return weather.attached(runs, found).select("run_id", "city", "ambient_temp_c", "pressure_hpa", "longitude", "fetch_successful")


def weather_join(spark: SparkSession, d: str) -> DataFrame:
    return _joined_weather(spark, d, adapters.table(spark, d, "nation"))


def weather_live(spark: SparkSession, d: str) -> DataFrame:
    """The weather of all cities through the data source, here from recorded answers, and its join to the runs."""
    cities = [r.n_name for r in adapters.table(spark, d, "nation").select("n_name").collect()]  # one row a nation
    source = weather_of(spark, cities, get="panelwright.sources.adapters:recorded_answer", pause_s="0")
    found = settled(weather.parsed(source).where("weather.fetch_successful"), "answers")
    of_city = found.select("city", *[F.col(f"weather.{c}").alias(c) for c in weather.PATHS])
    runs = adapters.observations(spark, d).select("run_id", "city")
    return weather.attached(runs, of_city).select("run_id", "city", *weather.PATHS, "fetch_successful")


def detection_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Boxes gathered per image, then flattened again."""
    gathered = adapters.boxes(spark, d).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("ord", "box", "confidence", "class_id"))).alias("b"))
    images = gathered.select("run_id", F.col("b.box").alias("boxes"), F.col("b.confidence").alias("confidences"), F.col("b.class_id").alias("class_ids"))
    return vision.detections_long(images).select("run_id", "ord", F.get("box", F.lit(2)).alias("x2"), "confidence", "class_id")


def detection_summary(spark: SparkSession, d: str) -> DataFrame:
    runs = adapters.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"))
    return vision.detection_summary(runs, adapters.boxes(spark, d))


def detection_nms(spark: SparkSession, d: str) -> DataFrame:
    """What is left of every image's raw boxes, from the most confident one."""
    kept = vision.suppressed(F.col("boxes"), F.col("confidences"), F.col("class_ids"))
    found = adapters.raw_detections(spark, d).select("run_id", F.posexplode(kept).alias("position", "k"))
    return found.select("run_id", "position", "k.ord", "k.class_id", "k.confidence", F.get("k.box", F.lit(2)).alias("x2"))


class BrightCells:
    """NOT a trained detector: of the square's 8 x 8 cells those that are brighter than the threshold."""

    def __call__(self, square, conf, iou, imgsz):
        side = imgsz // 8
        sums = square[: side * 8, : side * 8].reshape(8, side, 8, side, 3).sum((1, 3, 4), dtype="int64")
        light = sums / (side * side * 3 * 255.0)
        rows, columns = (light > conf).nonzero()
        boxes = [(x * side, y * side, x * side + side, y * side + side) for y, x in zip(rows.tolist(), columns.tolist())]
        return [(boxes, light[rows, columns].tolist(), [0] * len(boxes))]


class ChannelMoments:
    """NOT a trained classifier: means and spreads of the three channels stand for the scores of six classes."""

    def __call__(self, tensor):
        wide = tensor.astype("float64")
        return [*wide.mean((1, 2)).tolist(), *wide.std((1, 2)).tolist()]


def _looked_at(spark: SparkSession, d: str, s: Settings = DEFAULT) -> DataFrame:
    """All images with what the stand-ins for both image models say of them."""
    models = prediction.Model("YOLO", BrightCells, "bright-cells"), prediction.Model("MobileNet", ChannelMoments, "channel-moments")
    df = vision.inferred(adapters.images(spark, d), *models, s=s).drop("content")
    return vision.with_classification(vision.with_detection(df, F.col("image.detection")), F.col("image.classification"), s)


def image_models(spark: SparkSession, d: str) -> DataFrame:
    return _looked_at(spark, d, Settings(detector_size=THUMBNAILS[0], classifier_size=THUMBNAILS[1])).select(
        "run_id", F.coalesce("image.error", F.lit("")).alias("error"), "panel_count", "detection_confidence", "label", py_round(F.col("class_confidence"), 3).alias("class_confidence")
    )


def image_runs(spark: SparkSession, d: str) -> DataFrame:
    """Whole runs that begin with an image's bytes, at the models' own sizes."""
    inputs_ = adapters.runs(spark, d).drop("label", "detection_confidence")
    df = _looked_at(spark, d).withColumns({"image_error": F.col("image.error"), "weather_crashed": F.lit(False)}).drop("image").join(inputs_, "run_id")
    return pipeline.run(df).select(
        "run_id", "status", "error_stage", "error_type", "error_message", "panel_count", "label", "efficiency_loss_pct", "overall_severity", "recommendation"
    )


def detection_validate(spark: SparkSession, d: str) -> DataFrame:
    b = adapters.boxes(spark, d).withColumn(
        "confidence", F.when(F.col("run_id") % 13 == 0, F.col("confidence") + 1).when(F.col("run_id") % 29 == 0, F.lit(float("nan"))).otherwise(F.col("confidence"))
    )
    return vision.with_box_errors(b).where("error is not null").select("run_id", "ord", "error")


def softmax_query(spark: SparkSession, d: str) -> DataFrame:
    return adapters.logits(spark, d).select("run_id", F.posexplode(_rounded(softmax(F.col("logits")))).alias("class_id", "p"))


def argmax_label(spark: SparkSession, d: str) -> DataFrame:
    """Eight logits for six labels: the last two have none."""
    return adapters.logits(spark, d, 8).select("run_id", argmax(F.col("logits")).alias("class_id")).withColumn("label", label_of(F.col("class_id"), LABELS))


def probability_map(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("run_id", F.explode("probabilities").alias("label", "p")).withColumn("p", py_round(F.col("p"), 6))


def classification_validate(spark: SparkSession, d: str) -> DataFrame:
    """Raw numbers in place of probabilities: some are negative, some rows hold NaN."""
    p = F.when(F.col("run_id") % 11 == 0, F.transform("logits", lambda x: F.lit(float("nan")))).otherwise(F.transform("logits", lambda x: x + 0.2))
    return adapters.logits(spark, d).select("run_id", F.coalesce(probability_error(p), F.lit("")).alias("error"))


def tensor_normalize(spark: SparkSession, d: str) -> DataFrame:
    pixels = F.array(*[(F.col("event_id") * k % 256).cast("double") for k in (1, 3, 7)])
    return adapters.table(spark, d, "events").select(
        F.col("event_id").alias("run_id"),
        *[_rounded(normalised(pixels, m, s))[i].alias(f"channel_{i}") for i, (m, s) in enumerate(zip(IMAGE_MEAN, IMAGE_STD))],
    )


def _geometry(make: Callable[[Column, Column], Column]) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        e = F.col("event_id")
        return adapters.table(spark, d, "events").select(
            e.alias("run_id"), make((e * 31 % 1999 + 1).cast("int"), (e * 17 % 1499 + 1).cast("int")).alias("g")
        ).select("run_id", "g.*")

    return query


def image_decode(spark: SparkSession, d: str) -> DataFrame:
    """Size and pixels of every image, or what is wrong with it."""
    i = F.col("image")
    return images.prepared(adapters.images(spark, d), "pixels").select(
        "run_id", i.ok.alias("ok"), F.coalesce(i.error, F.lit("")).alias("error"), i.width.alias("width"), i.height.alias("height"), F.md5(i.pixels).alias("pixels_md5")
    )


def _model_inputs(s: Settings) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        i = F.col("image")
        found = images.prepared(adapters.images(spark, d), "detector", "classifier", s=s)
        return found.select("run_id", F.coalesce(i.error, F.lit("")).alias("error"), F.md5(i.detector).alias("detector_md5"), F.md5(i.classifier).alias("classifier_md5"))

    return query


def prediction_postprocess(spark: SparkSession, d: str) -> DataFrame:
    return prediction.with_prediction(_raw_outputs(spark, d), F.col("raw")).select("run_id", "efficiency_loss_pct", "estimated_output_w", "prediction_successful")


def prediction_validate(spark: SparkSession, d: str) -> DataFrame:
    return _raw_outputs(spark, d).select("run_id", prediction.output_error(F.col("raw")).alias("error")).where("error is not null")


def recommendations_long(spark: SparkSession, d: str) -> DataFrame:
    return rules.long_form(_predicted(spark, d))


def recommendation_report(spark: SparkSession, d: str) -> DataFrame:
    return _advised(spark, d).select("run_id", "overall_severity", "summary", "recommendation", "priority", F.size("recommendations").alias("n_issues"))


def report_json(spark: SparkSession, d: str) -> DataFrame:
    return _advised(spark, d).select("run_id", rules.report_json().alias("report"))


def severity_counts(spark: SparkSession, d: str) -> DataFrame:
    return _advised(spark, d).groupBy("city", "overall_severity").agg(F.count("*").alias("n"), F.min("estimated_output_w").alias("least_output_w"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("run_id")
    return pipeline.run(
        adapters.runs(spark, d).withColumns(
            {
                "image_error": F.when(e % 83 == 0, "no image data"),
                "detection_error": F.when(e % 59 == 0, "confidence non-finite"),
                "classification_error": F.when(e % 61 == 0, "negative values"),
                "weather_crashed": e % 67 == 0,
                "city": F.when(e % 71 == 0, "").otherwise(F.col("city")),
            }
        )
    )


def pipeline_run(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select(
        "run_id", "status", "error_stage", "city", "label", "irradiance_wm2", "module_temp_c", "efficiency_loss_pct", "overall_severity", "recommendation"
    )


def pipeline_errors(spark: SparkSession, d: str) -> DataFrame:
    failed = _runs(spark, d).where("status = 'ERROR'")
    return failed.groupBy("error_stage", "error_type", "error_message").agg(F.count("*").alias("n"), F.min("run_id").alias("first_run"))


def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Where the runs ended, counted while they were written."""
    metrics = RunMetrics("runs", pipeline.STAGES)
    runs = metrics.over(_runs(spark, d))
    metrics.timed(lambda: runs.write.format("noop").mode("overwrite").save())
    return metrics.table(spark).select("stage", "rows", (F.col("seconds") > 0).alias("timed"))


def ui_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _predicted(spark, d).select(
        "run_id", percent(c("detection_confidence"), 1).alias("confidence"), F.concat(fixed(c("ambient_temp_c"), 1), F.lit(" °C")).alias("temperature"),
        F.concat(fixed(c("irradiance_wm2"), 0), F.lit(" W/m²")).alias("irradiance"), fixed(c("soiling_ratio"), 2).alias("soiling"),
        F.concat(fixed(c("estimated_output_w"), 0), F.lit(" W")).alias("output"),
    )


def severity_colour(spark: SparkSession, d: str) -> DataFrame:
    return _advised(spark, d).select("overall_severity", rules.colour(F.col("overall_severity")).alias("colour")).distinct()


def _manifest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as artifacts with all kinds of faulty entries, and the files that there are."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("m/"), k.cast("string"), F.lit(".bin"))
    digest = F.sha2(F.col("s_name"), 256)
    t = adapters.table(spark, d, "supplier")
    entries = t.select(
        k.alias("ord"),
        F.when(k % 11 == 0, F.concat(F.lit("/"), name)).when(k % 11 == 1, F.concat(F.lit("m/../../"), name)).when(k % 11 == 2, F.lit("")).otherwise(name).alias("path"),
        F.when(k % 11 == 3, F.lit("xyz")).when(k % 11 == 4, F.upper(digest)).when(k % 11 == 5, F.sha2(F.lit("other"), 256)).otherwise(digest).alias("sha256"),
    )
    return entries, t.where(k % 11 != 6).select(name.alias("path"), digest.alias("actual"))


def manifest_verify(spark: SparkSession, d: str) -> DataFrame:
    entries, files = _manifest(spark, d)
    return artifacts.entry_errors(entries, files).select("ord", F.coalesce("error", F.lit("")).alias("error"))


def manifest_files(spark: SparkSession, d: str) -> DataFrame:
    """The same manifest against files that are written first: some are missing, one name is a link that leads outside."""
    entries, files = _manifest(spark, d)
    root = work_dir(spark, "artifacts")
    artifacts.write_files(files.join(adapters.table(spark, d, "supplier").select(F.concat(F.lit("m/"), F.col("s_suppkey").cast("string"), F.lit(".bin")).alias("path"), F.col("s_name").cast("binary").alias("content")), "path"), root)
    linked = entries.withColumn("path", F.when(F.col("ord") % 11 == 7, F.lit("link/1.bin")).otherwise(F.col("path")))
    artifacts.link_outside(root, "link")
    checked = artifacts.entry_errors(linked, artifacts.files_of(linked, root)).withColumn("manifest_id", F.lit(1) + F.col("ord") % 3)
    return artifacts.manifest_reports(checked, 7).select("manifest_id", "ok", F.posexplode_outer("errors").alias("position", "line"))


def missing_artifacts(spark: SparkSession, d: str) -> DataFrame:
    entries, files = _manifest(spark, d)
    return entries.join(files, "path", "left_anti").select("ord", "path")


def artifact_readiness(spark: SparkSession, d: str) -> DataFrame:
    status = adapters.table(spark, d, "region").select(F.col("r_name").alias("name"), (F.col("r_regionkey") % 2 == 0).alias("exists"))
    return artifacts.readiness(status)


class Surrogate:
    """Reads the model's columns only: the surrogate loss from soiling and module temperature."""

    def predict(self, frame):
        loss = (-(-0.004 * (frame["module_temp_c"] - 25.0) * 100.0)).clip(lower=0.0)
        return (100.0 * (1.0 - frame["soiling_ratio"] * (1.0 - loss / 100.0))).round(6)


def predict_pandas(spark: SparkSession, d: str) -> DataFrame:
    return prediction.predicted(_features(spark, d), Surrogate).select("run_id", py_round(F.col("raw_prediction"), 4).alias("raw_prediction"))


def _measured(spark: SparkSession, d: str) -> DataFrame:
    """Features with a measured loss: what the physics say, and a deviation of up to one percent."""
    loss = prediction.surrogate_loss(F.col("effective_efficiency")) + ((F.col("run_id") * 7919 % 1000) / F.lit(500.0) - 1.0)
    return settled(_features(spark, d).withColumn("measured", loss), "measured")


def regression_fit(spark: SparkSession, d: str) -> DataFrame:
    """The fitted stumps, in order; the row of round 0 is the base."""
    model = regression.fit(_measured(spark, d), "measured")
    rows = [(0, "", None, model.base, model.base), *[(i + 1, s.feature, s.edge, s.left, s.right) for i, s in enumerate(model.stumps)]]
    return spark.createDataFrame(rows, "round int, feature string, edge double, below long, above long")


def regression_predictions(spark: SparkSession, d: str) -> DataFrame:
    """A model is fitted, saved, loaded again and run over all rows."""
    path = work_dir(spark, "regressor")
    features_ = _measured(spark, d)
    regression.save(spark, regression.fit(features_, "measured"), path)
    found = regression.with_saved_model(features_, path)
    return prediction.with_prediction(found, F.col("raw_prediction"), error=F.col("model_error")).select("run_id", "raw_prediction", "efficiency_loss_pct", "prediction_successful")


def stream_equals_batch(spark: SparkSession, d: str) -> DataFrame:
    """The physics plan over a file stream of ``events``, read back."""
    from panelwright.streaming.replay import run_available, stream_of

    out = work_dir(spark, "stream")
    nation = adapters.table(spark, d, "nation")
    events = stream_of(spark, f"{d}/event[s].parquet", adapters.table(spark, d, "events"))
    run_available(events, lambda e: physics.with_physics(adapters.observed(e, nation)).select("run_id", "irradiance_wm2", "effective_efficiency"), f"{out}/data", f"{out}/state")
    return spark.read.parquet(f"{out}/data")


def weather_as_of(spark: SparkSession, d: str) -> DataFrame:
    return weather.as_of(*adapters.weather_log(spark, d))


def weather_as_of_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stream in which observations arrive up to ten minutes late, and which goes on from its checkpoint; a last row closes the log."""
    from panelwright.streaming import weather_state as state
    from panelwright.streaming.replay import run_available, stream_of

    runs, seen = adapters.weather_log(spark, d)
    fields = list(weather.PATHS)
    rows = runs.select(F.lit(state.RUN).alias("kind"), "city", "at", "run_id", *[F.lit(None).cast("double").alias(c) for c in fields], F.col("at").alias("arrival")).union(
        seen.select(F.lit(state.OBSERVATION), "city", "at", F.lit(None).cast("long"), *fields, F.timestamp_micros(F.unix_micros("at") + F.col("event_id") * 37 % 600 * 1_000_000))
    )
    like, us = rows.drop("arrival"), F.unix_micros("arrival")
    ends = rows.agg(F.min(us).alias("lo"), F.max(us).alias("hi")).first()
    lo, hi = ends.lo or 0, (ends.hi or 0) + 1
    last = {"kind": F.lit(2), "at": F.timestamp_micros(F.lit(hi + 86_400_000_000))}
    closing = spark.range(1).select(*[last.get(c, F.lit(None)).cast(like.schema[c].dataType).alias(c) for c in like.columns])
    parts = [rows.where(us.between(lo + (hi - lo) * k // LOG_PARTS, lo + (hi - lo) * (k + 1) // LOG_PARTS - 1)).drop("arrival") for k in range(LOG_PARTS)]
    out = work_dir(spark, "weather-log")
    for k, part in enumerate([*parts, closing]):
        part.write.parquet(f"{out}/log/{k}")
        run_available(stream_of(spark, f"{out}/log/*", like), lambda r: state.as_of_stream(r, "15 minutes"), f"{out}/data", f"{out}/state")
    return spark.read.parquet(f"{out}/data")


QUERIES: dict[str, Query] = {
    "cloud_factor": _steps("cloud_factor"),
    "wind_cooling": _steps("wind_cooling_factor"),
    "irradiance": _steps("irradiance_wm2"),
    "module_temperature": _steps("module_temp_c"),
    "soiling_ratio": soiling_ratio,
    "temperature_loss": _steps("temp_loss_pct"),
    "effective_efficiency": _steps("effective_efficiency"),
    "compute_physics": _steps(*physics.PHYSICS_COLUMNS),
    "as_of_default": as_of_default,
    "feature_vector_raw": _column(*features.RAW_COLUMNS, of=_features),
    "feature_vector_model": lambda spark, d: features.model_vector(_features(spark, d)),
    "feature_gap_fill": feature_gap_fill,
    "validate_nan": validate_nan,
    "validate_ranges": validate_ranges,
    "validate_consistency": validate_consistency,
    "validation_report": validation_report,
    "feature_errors": feature_errors,
    "input_validation": input_validation,
    "finite_check": finite_check,
    "default_city": default_city,
    "ui_bounds": ui_bounds,
    "city_validate": _text_query(text.valid_city, "city"),
    "city_sanitize": _text_query(text.clean_city, "city"),
    "log_sanitize": _text_query(text.log_safe, "line"),
    "weather_parse": weather_parse,
    "weather_fallback": weather_fallback,
    "weather_join": weather_join,
    "weather_live": weather_live,
    "weather_as_of": weather_as_of,
    "weather_as_of_stream": weather_as_of_stream,
    "weather_join_all": weather_join,
    "detection_flatten": detection_flatten,
    "detection_summary": detection_summary,
    "detection_summary_all": detection_summary,
    "detection_validate": detection_validate,
    "softmax": softmax_query,
    "argmax_label": argmax_label,
    "probability_map": probability_map,
    "classification_validate": classification_validate,
    "tensor_normalize": tensor_normalize,
    "letterbox_geometry": _geometry(vision.letterbox),
    "center_crop_geometry": _geometry(vision.center_crop),
    "detection_nms": detection_nms,
    "image_decode": image_decode,
    "image_models": image_models,
    "image_runs": image_runs,
    "image_inputs": _model_inputs(DEFAULT),
    "image_thumbnails": _model_inputs(Settings(detector_size=THUMBNAILS[0], classifier_size=THUMBNAILS[1])),
    "prediction_postprocess": prediction_postprocess,
    "prediction_validate": prediction_validate,
    "rule_fault_class": _rule(lambda: rules.fault_class(F.col("label"))),
    "rule_efficiency_loss": _rule(lambda: rules.efficiency_loss(F.col("efficiency_loss_pct"))),
    "rule_module_temp": _rule(lambda: rules.module_temperature(F.col("module_temp_c"))),
    "rule_low_irradiance": _rule(lambda: rules.low_irradiance(F.col("irradiance_wm2"))),
    "recommendations_long": recommendations_long,
    "overall_severity": _column("overall_severity", of=_advised),
    "recommendation_report": recommendation_report,
    "top_action": _column("recommendation", of=_advised),
    "report_json": report_json,
    "severity_counts": severity_counts,
    "pipeline_run": pipeline_run,
    "pipeline_errors": pipeline_errors,
    "run_metrics": run_metrics,
    "ui_metrics": ui_metrics,
    "severity_colour": severity_colour,
    "manifest_verify": manifest_verify,
    "manifest_files": manifest_files,
    "missing_artifacts": missing_artifacts,
    "artifact_readiness": artifact_readiness,
    "predict_pandas": predict_pandas,
    "regression_fit": regression_fit,
    "regression_predictions": regression_predictions,
    "stream_equals_batch": stream_equals_batch,
}
