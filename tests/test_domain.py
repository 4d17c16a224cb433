"""Features, advice, weather, vision, inputs, predictions, text, artifacts, settings."""

import hashlib
import json
import math
import os
import re

import pytest
from panelwright import errors, settings
from panelwright.functions import arrays, text
from panelwright.operators import artifacts, features, inputs, prediction, rules, vision, weather
from panelwright.plans import pipeline
from pyspark.sql import functions as F

VALID = dict(zip(features.RAW_COLUMNS, (888.0, 49.75, 25.0, 50.0, 2.0, 30.0, 1.0, 0.0, 0.92, 24.75, 0.925, 3.0)))


def feature_frame(spark, *changes):
    rows = [(i, *({**VALID, **c}[k] for k in features.RAW_COLUMNS)) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, "run_id int, " + ", ".join(f"{c} double" for c in features.RAW_COLUMNS))


def test_ranges_are_inclusive_and_all_reported(spark):
    changes, want = [{}], ["VALID"]
    for c, (lo, hi) in settings.FEATURE_RANGES.items():
        for v, ok in ((lo, True), (hi, True), (lo - 1, False), (hi + 1, False), (math.inf, False), (-math.inf, False)):
            change = {c: v}
            if c in ("irradiance_wm2", "module_temp_c"):
                change |= {"irradiance_wm2": v if c == "irradiance_wm2" else 888.0, "ambient_temp_c": 50.0}
            changes.append(change)
            want.append("VALID" if ok else "RANGE")
    for v in (math.nan, None):
        changes += [{c: v} for c in features.RAW_COLUMNS]
        want += ["NAN"] * len(features.RAW_COLUMNS)
    got = features.validated(feature_frame(spark, *changes)).orderBy("run_id").collect()
    assert [r.feature_status for r in got] == want
    two = features.validated(feature_frame(spark, {"humidity_pct": 101.0, "cloud_factor": 2.0})).first()
    assert len(two.violations) == 2 and two.violations == ["  'humidity_pct': 101 is outside [0.0, 100.0]", "  'cloud_factor': 2 is outside [0.0, 1.0]"]


@pytest.mark.parametrize(("irr", "module", "odd"), [(0.0, 40.01, True), (9.99, 40.01, True), (10.0, 120.0, False), (0.0, 40.0, False)])
def test_consistency(spark, irr, module, odd):
    r = features.validated(feature_frame(spark, {"irradiance_wm2": irr, "module_temp_c": module})).first()
    assert ("  " + features.CONSISTENCY in r.violations) == odd


def test_strict_fails_the_job(spark):
    assert features.strict(feature_frame(spark, {}, {})).count() == 2
    cases = [({"humidity_pct": 900.125}, "'humidity_pct': 900.1 is outside"), ({"humidity_pct": math.nan, "cloud_factor": None}, "NaN values in columns: ['humidity_pct', 'cloud_factor']")]
    for change, text in cases:
        with pytest.raises(Exception, match="(?s)Feature validation failed: .*" + re.escape(text)) as found:
            features.strict(feature_frame(spark, {}, change)).collect()
        assert "USER_RAISED_EXCEPTION" in str(found.value)
    with pytest.raises(errors.FeatureValidationError, match=re.escape("Feature validation failed: DataFrame is missing required columns: ['humidity_pct']")):
        features.strict(feature_frame(spark, {}).drop("humidity_pct"))


def test_kinds_of_errors():
    import pickle

    found = errors.ModelLoadError("no file", "YOLO")
    again = pickle.loads(pickle.dumps(found))
    assert isinstance(found, errors.FleetError) and str(found) == str(again) == "[YOLO] Model load failed: no file"
    assert str(errors.WeatherAPIError("timeout", "Oslo")) == "Weather API error for city 'Oslo': timeout" and str(errors.FleetError("x")) == "x"


def test_missing_columns_and_class_ids(spark):
    assert features.missing_columns(["humidity_pct", "x"]) == sorted(set(settings.MODEL_COLUMNS) - {"humidity_pct"})
    labels = [*settings.LABELS, "Unknown", "", None, "clean"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, label string").orderBy("i").select(features.class_id(F.col("label")).alias("c")).collect()
    assert [r.c for r in got] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 0.0, 0.0, 0.0, 0.0]


ADVICE = [
    (("Clean", 2.0, 49.75, 888.0), ["OK"], "OK", "Continue regular inspection schedule"),
    (("Dusty", 15.0, 49.75, 888.0), ["WARNING", "WARNING"], "WARNING", "Schedule surface cleaning"),
    (("Dusty", 25.0, 49.75, 888.0), ["CRITICAL", "WARNING"], "CRITICAL", "Schedule emergency maintenance"),
    (("Physical-Damage", 30.0, 49.75, 888.0), ["CRITICAL", "CRITICAL"], "CRITICAL", "Replace the damaged panel"),
    (("Hotspot", 2.0, 66.0, 888.0), ["CRITICAL", "WARNING"], "CRITICAL", "Inspect bypass diodes and shading sources; replace if needed"),
    (("Clean", 2.0, 49.75, 10.0), ["INFO", "OK"], "INFO", "Re-run analysis during daylight hours"),
    (("Dusty", 2.0, 66.0, 10.0), ["WARNING", "WARNING", "INFO"], "WARNING", "Schedule surface cleaning"),
    (("Clean", 15.0, 66.0, 888.0), ["WARNING", "WARNING", "OK"], "WARNING", "Schedule maintenance within 7 days"),
    (("Clean", 10.0, 65.0, 50.0), ["WARNING", "WARNING", "OK"], "WARNING", "Schedule maintenance within 7 days"),
    (("Clean", 20.0, 64.99, 49.99), ["CRITICAL", "INFO", "OK"], "CRITICAL", "Schedule emergency maintenance"),
    (("Clean", math.nan, math.nan, math.nan), ["OK"], "OK", "Continue regular inspection schedule"),
    (("Mould", 2.0, 49.75, 888.0), ["INFO"], "INFO", "Perform visual inspection"),
]


def test_advice(spark):
    df = spark.createDataFrame([(i, *a) for i, (a, *_) in enumerate(ADVICE)], "run_id int, label string, efficiency_loss_pct double, module_temp_c double, irradiance_wm2 double")
    got = rules.with_report(df).withColumn("json", rules.report_json()).orderBy("run_id").collect()
    for r, (_, severities, overall, action) in zip(got, ADVICE):
        assert [x.severity for x in r.recommendations] == severities
        assert (r.overall_severity, r.recommendation, r.summary) == (overall, action, rules.SUMMARIES[overall])
        report = json.loads(r.json)
        assert list(report) == ["status", "summary", "issues", "recommendation", "priority"] and len(report["issues"]) == len(severities)
    assert "loss of 25.0% exceeds the critical threshold (20%)" in got[2].recommendations[0].message
    assert got[11].recommendations[0].message == "Fault class 'Mould' detected. Manual inspection recommended."
    assert rules.long_form(df).count() == sum(len(s) for _, s, *_ in ADVICE)


PAYLOAD = {
    "name": "Chennai", "main": {"temp": 28.5, "humidity": 65, "pressure": 1008.5}, "wind": {"speed": 3.2}, "clouds": {"all": 40},
    "coord": {"lat": 13.08, "lon": 80.27}, "dt": 1697904000, "weather": [{"description": "clear sky"}],
}


def without(*path):
    p = json.loads(json.dumps(PAYLOAD))
    node = p
    for k in path[:-1]:
        node = node[k]
    del node[path[-1]]
    return p


def test_weather_is_all_or_nothing(spark):
    cases = [
        ("Chennai", PAYLOAD, True, False), ("x", without("name"), True, False), ("x", without("main", "temp"), False, False),
        ("x", {**PAYLOAD, "main": {**PAYLOAD["main"], "temp": "28.5"}}, True, False), ("x", {**PAYLOAD, "main": {**PAYLOAD["main"], "temp": "hot"}}, False, False),
        ("x", {**PAYLOAD, "wind": None}, False, False), ("x", {}, False, False), ("", PAYLOAD, False, False), ("a\tb", PAYLOAD, False, False), (None, PAYLOAD, False, False),
        ("x", {**PAYLOAD, "weather": []}, False, True), ("x", [1], False, True), ("x", {**PAYLOAD, "dt": 1e18}, False, True), ("x", None, False, False), ("x", without("dt"), False, False),
    ]
    df = spark.createDataFrame([(i, c, None if p is None else json.dumps(p)) for i, (c, p, *_) in enumerate(cases)], "i int, city string, payload string")
    got = weather.parsed(df).orderBy("i").collect()
    for r, (city, _, ok, crashed) in zip(got, cases):
        assert (r.weather.fetch_successful, r.crashed, r.degraded) == (ok, crashed, not ok and not crashed), r
        if ok:
            assert (r.weather.ambient_temp_c, r.weather.longitude, r.weather.description) == (28.5, 80.27, "clear sky") and r.weather.timestamp.isoformat() == "2023-10-21T16:00:00"
        else:
            assert (r.weather.ambient_temp_c, r.weather.pressure_hpa, r.weather.latitude, r.weather.timestamp) == (25.0, 1013.25, 0.0, None)
    assert got[1].weather.city == "x" and got[0].weather.city == "Chennai"


def test_weather_join_keeps_every_run(spark):
    runs = spark.createDataFrame([(1, " A "), (2, "B"), (3, None), (4, "A")], "run_id int, city string")
    row = ["A", *[1.0] * 7]
    found = spark.createDataFrame([row, ["A", *[2.0] * 7]], "city string, " + ", ".join(f"{p} double" for p in weather.PATHS))
    got = {r.run_id: (r.ambient_temp_c, r.fetch_successful) for r in weather.attached(runs, found).collect()}
    assert got == {1: (1.0, True), 2: (25.0, False), 3: (25.0, False), 4: (1.0, True)}


TEXTS = ["Chennai", "", "   ", "a\tb", "x\n", "\x7f", "　São Paulo　", "A" * 150, "../../../etc/passwd", "  Chennai   Tamil Nadu  ", "Chennai\nIN\t", None]


def test_text_policies(spark):
    got = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").orderBy("i").select("t", text.valid_city(F.col("t")).alias("v"), text.clean_city(F.col("t")).alias("c"), text.log_safe(F.col("t"), 20).alias("s"), text.not_blank(F.col("t")).alias("n")).collect()
    control = {chr(c) for c in [*range(32), 127]}
    for r in got:
        if r.t is None:
            assert (r.v, r.c, r.s, r.n) == (None, None, None, False)
            continue
        bad = any(c in control for c in r.t) or not r.t.strip()
        assert r.v == (None if bad else r.t.strip()[:100])
        assert r.c == " ".join("".join(" " if c in control else c for c in r.t).split())[:100]
        kept = "".join(c for c in r.t if c not in control)
        assert r.s == (kept[:20] + "..." if len(kept) > 20 else kept)
        assert r.n == bool(r.t.strip())


def test_scores(spark):
    logits = [[1.0, 2.0, 2.0, 0.0, -1.0, 0.5], [1000.0, 0.0, 0.0, 0.0, 0.0, 0.0], [0.0] * 6]
    got = vision.classified(spark.createDataFrame([(i, x) for i, x in enumerate(logits)], "run_id int, logits array<double>")).orderBy("run_id").collect()
    for r, x in zip(got, logits):
        e = [math.exp(v - max(x)) for v in x]
        assert all(abs(a - b / sum(e)) < 1e-12 for a, b in zip(r.probs, e))
        assert r.class_id == x.index(max(x)) and r.label == settings.LABELS[r.class_id] and set(r.probabilities) == set(settings.LABELS)
    one = spark.range(1).select(arrays.label_of(F.lit(7), settings.LABELS).alias("a"), arrays.label_of(F.lit(-1), settings.LABELS).alias("b"), arrays.by_label(F.array(F.lit(0.5)), settings.LABELS).alias("m")).first()
    assert (one.a, one.b, one.m) == ("Unknown", "Unknown", {"Clean": 0.5})


def test_model_output_checks(spark):
    p = [([0.5, 0.5], None), ([0.5, math.nan], "non-finite values"), ([0.5, math.inf], "non-finite values"), ([-0.1, 0.5], "negative values"), ([0.2, 1.5], "confidence out of range [0,1]")]
    got = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(p)], "i int, p array<double>").orderBy("i").select(arrays.probability_error(F.col("p")).alias("e")).collect()
    assert [r.e for r in got] == [e for _, e in p]
    boxes = [([[0.0, 1.0]], [0.5], None), ([[0.0, math.nan]], [0.5], "non-finite coordinates"), ([[0.0, 1.0], [2.0, 3.0]], [0.5, 1.5], "confidence out of range [0,1]"), ([], [], None), ([[1.0]], [math.nan], "confidence non-finite")]
    got = spark.createDataFrame([(i, b, c) for i, (b, c, _) in enumerate(boxes)], "i int, b array<array<double>>, c array<double>").orderBy("i").select(arrays.first_box_error(F.col("b"), F.col("c")).alias("e")).collect()
    assert [r.e for r in got] == [e for *_, e in boxes]


@pytest.mark.parametrize(("w", "h"), [(1280, 720), (720, 1280), (640, 640), (55, 200), (1, 1000), (71, 83), (333, 334)])
def test_geometry(spark, w, h):
    r = spark.range(1).select(vision.letterbox(F.lit(w), F.lit(h)).alias("l"), vision.center_crop(F.lit(w), F.lit(h)).alias("c")).first()
    ratio = w / h
    nw, nh = (640, int(640 / ratio)) if ratio > 1 else (int(640 * ratio), 640)
    assert tuple(r.l) == (nw, nh, (640 - nw) // 2, (640 - nh) // 2)
    scale = 224 / min(w, h)
    nw, nh = int(w * scale), int(h * scale)
    assert tuple(r.c) == (nw, nh, (nw - 224) // 2, (nh - 224) // 2)


def test_inputs_in_order(spark):
    ok = (5.0, 2, 30.0, 5.0, "rooftop")
    cases = [(ok, None), ((-1.0, -1, 1.0, 1.0, "x"), "panel_age"), ((101.0, *ok[1:]), "panel_age"), ((math.nan, *ok[1:]), "panel_age"), ((None, *ok[1:]), "panel_age"), ((5.0, -1, math.inf, 1.0, "x"), "maintenance_count"), ((5.0, None, 1.0, 1.0, "x"), "maintenance_count"), ((5.0, 1, math.inf, 1.0, "x"), "voltage"), ((5.0, 1, -1.0, 1.0, "x"), "voltage"), ((5.0, 1, 1.0, None, "x"), "current"), ((5.0, 1, 1.0, 1.0, " 　"), "installation_type"), ((5.0, 1, 1.0, 1.0, None), "installation_type"), ((0.0, 0, 0.0, 0.0, "x"), None), ((100.0, 0, 0.0, 0.0, "x"), None)]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, panel_age double, maintenance_count int, voltage double, current double, installation_type string")
    for r, (_, name) in zip(inputs.with_input_error(df).orderBy("i").collect(), cases):
        assert (r.input_error is None) if name is None else r.input_error.startswith(f"'{name}'")


def test_predictions(spark):
    raw = [(-10.0, 0.0, 400.0, None), (150.0, 100.0, 0.0, None), (25.5, 25.5, 298.0, None), (math.nan, 0.0, 0.0, "finite"), (math.inf, 0.0, 0.0, "finite"), (None, 0.0, 0.0, "Invalid")]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(raw)], "run_id int, raw double")
    for r, (_, loss, watts, error) in zip(prediction.with_prediction(df, F.col("raw")).orderBy("run_id").collect(), raw):
        assert (r.efficiency_loss_pct, r.estimated_output_w) == (loss, watts) and (error in r.prediction_error if error else r.prediction_successful)
    with pytest.raises(errors.ModelLoadError):
        prediction.predicted(df, None)

    class Broken:
        def predict(self, frame):
            raise RuntimeError

    assert [r.raw_prediction is None or math.isnan(r.raw_prediction) for r in prediction.predicted(feature_frame(spark, {}), Broken).collect()] == [True]


def test_first_failing_stage_decides(spark):
    base = dict(image_error=None, panel_age=1.0, maintenance_count=0, voltage=1.0, current=1.0, installation_type="roof", detection_error=None, classification_error=None, weather_crashed=False, city="X", humidity_pct=50.0)
    cases = [
        ({}, "none", ""), (dict(image_error="no image", panel_age=-1.0), "image", "Image validation failed: no image"), (dict(panel_age=-1.0, detection_error="d"), "inputs", "Input validation failed: 'panel_age'"),
        (dict(detection_error="d", classification_error="c"), "detect", "[YOLO] Prediction failed: d"), (dict(classification_error="c", weather_crashed=True), "classify", "[MobileNet] Prediction failed: c"),
        (dict(weather_crashed=True, humidity_pct=500.0), "weather", pipeline.GENERIC), (dict(humidity_pct=500.0), "features", "Feature validation failed: One or more feature values failed validation:\n  'humidity_pct': 500 is outside [0.0, 100.0]"), (dict(humidity_pct=math.nan), "features", "Feature validation failed: DataFrame contains NaN values in columns: ['humidity_pct']"), (dict(city=""), "none", ""),
    ]
    rows = [(i, *({**base, **c}.values())) for i, (c, *_) in enumerate(cases)]
    kinds = "i int, image_error string, panel_age double, maintenance_count int, voltage double, current double, installation_type string, detection_error string, classification_error string, weather_crashed boolean, city string, humidity_pct double"
    df = spark.createDataFrame(rows, kinds).selectExpr("*", "i run_id", "30.0D ambient_temp_c", "1.0D wind_speed_ms", "0.0D cloud_cover_pct", "'Dusty' label", "0.0D latitude", "0.0D longitude", "cast(null as timestamp_ntz) observation_time", "0.9D detection_confidence")
    got = pipeline.run(df, as_of=F.lit("2026-07-14 12:00:00").cast("timestamp_ntz")).orderBy("i").collect()
    for r, (_, stage, message) in zip(got, cases):
        assert r.error_stage == stage and r.error_message.startswith(message) and (r.status == "SUCCESS") == (stage == "none")
        assert (r.label == "Dusty") == (stage in ("none", "weather", "features"))
        assert (r.irradiance_wm2 == 1000.0) == (stage in ("none", "features"))
        assert (r.recommendation == rules.NO_ACTION) == (stage != "none")
    assert got[8].city == "Chennai"


def test_manifest(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.bin").write_bytes(b"weights")
    digest = hashlib.sha256(b"weights").hexdigest()
    entries = [("m/a.bin", digest, None), ("m/a.bin", digest.upper(), None), ("m/a.bin", "0" * 64, "SHA-256 mismatch"), ("m/b.bin", digest, "artifact missing"), ("/m/a.bin", digest, "artifact path must be relative to the manifest directory"), ("../a", digest, "artifact path escapes the manifest directory"), ("m/../../a", digest, "artifact path escapes the manifest directory"), ("m/a.bin", digest + "\n", "missing valid SHA-256 digest"), ("", digest, "artifact entry is missing a valid 'path'"), (None, digest, "artifact entry is missing a valid 'path'")]
    text_ = json.dumps({"artifacts": [{"path": p, "sha256": s} for p, s, _ in entries]})
    manifests = spark.createDataFrame([(1, text_), (2, "no json"), (3, '{"artifacts": []}')], "manifest_id int, value string")
    parsed = artifacts.manifest_entries(manifests)
    assert {r.manifest_id: r.manifest_error for r in parsed.where("manifest_id > 1").collect()} == {2: "invalid manifest: JSONDecodeError", 3: "manifest must contain a non-empty 'artifacts' list"}
    got = artifacts.entry_errors(parsed.where("manifest_id = 1"), artifacts.digests(spark, str(tmp_path))).orderBy("ord").collect()
    assert [r.error for r in got] == [e for *_, e in entries]
    os.symlink("/etc", tmp_path / "m/link")
    assert not artifacts.confined(str(tmp_path), "m/link/passwd") and artifacts.confined(str(tmp_path), "m/a.bin") and not artifacts.confined(str(tmp_path), "/etc")


def test_readiness(spark, tmp_path):
    (tmp_path / "weights").mkdir()
    (tmp_path / "weights/yolo_solar.pt").write_bytes(b"x")
    r = artifacts.readiness(artifacts.artifact_status(spark, str(tmp_path), settings.ARTIFACTS)).first()
    assert json.loads(r.payload) == {"inference_readiness": "not_ready", "liveness": "ok", "missing_artifacts": ["mobilenet", "xgboost"]} and r.exit_code == 2


def config():
    return {
        "weather": {"base_url": "u", "timeout_seconds": 10, "default_city": "Chennai", "units": "metric", "defaults": dict(settings.WEATHER_DEFAULTS)},
        "models": {"yolo": {"weights": "w", "confidence_threshold": 0.45, "iou_threshold": 0.5, "image_size": 640}, "mobilenet": {"weights": "w", "num_classes": 6, "input_size": 224}, "xgboost": {"weights": "w"}},
        "classification": {"labels": list(settings.LABELS)},
        "physics": {"max_irradiance_wm2": 1000.0, "irradiance_cloud_factor": 0.75, "noct_celsius": 45.0, "noct_irradiance_ref": 800.0, "noct_ambient_ref": 20.0, "wind_cooling_coefficient": 1.5, "temp_coefficient_pmax": -0.004, "stc_temperature": 25.0, "soiling_ratios": dict(settings.SOILING), "panel_rated_power_wp": 400.0},
        "feature_engineering": {"feature_columns": list(settings.MODEL_COLUMNS)},
        "recommendations": {"efficiency_loss_critical_pct": 20.0, "efficiency_loss_warning_pct": 10.0, "hotspot_max_temp_c": 65.0, "cleaning_humidity_threshold_pct": 85},
        "logging": {"level": "INFO", "format": "f"},
    }


@pytest.mark.parametrize(("path", "value"), [("weather.timeout_seconds", 0), ("weather.timeout_seconds", True), ("weather.timeout_seconds", "10"), ("weather.base_url", "  "), ("weather.defaults.humidity_pct", 101), ("models.yolo.iou_threshold", 1.5), ("classification.labels", []), ("physics.soiling_ratios", {}), ("physics.noct_irradiance_ref", 0), ("feature_engineering.feature_columns", ["a", " "]), ("recommendations.efficiency_loss_warning_pct", -1), ("weather.defaults", 3), ("logging", None)])
def test_bad_settings(path, value):
    c = config()
    *parents, last = path.split(".")
    node = c
    for p in parents:
        node = node[p]
    node[last] = value
    assert settings.config_problems(c)


def test_good_settings(tmp_path, monkeypatch):
    assert settings.config_problems(config()) == []
    (tmp_path / "c.json").write_text(json.dumps(config()))
    assert settings.load_settings(tmp_path / "c.json") == settings.DEFAULT
    missing = config()
    del missing["physics"]
    assert settings.config_problems(missing) and settings.config_problems([]) and settings.config_problems(None)
    monkeypatch.setenv("K", "env")
    assert (settings.secret("K", {"K": "store"}), settings.secret("K", {"K": ""}), settings.secret("NOT_SET", None, "f")) == ("store", "env", "f")


def test_digests_of_a_folder_with_odd_characters(spark, tmp_path):
    import hashlib

    from panelwright.operators.artifacts import digests

    root = tmp_path / "a+b (1)"
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "m.bin").write_bytes(b"x")
    got = [tuple(r) for r in digests(spark, str(root)).collect()]
    assert got == [("sub/m.bin", hashlib.sha256(b"x").hexdigest())]
