"""The fitted regressor: against a plain loop, after reload, with damaged files, and inside a whole run."""

import math
import random

import pytest
from panelwright.errors import ModelLoadError
from panelwright.operators import regression as R
from panelwright.plans import pipeline, queries
from panelwright.sources import adapters
from pyspark.sql import functions as F


def rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.uniform(-5, 5), rng.choice([0.0, 1.0, None, math.nan]), 3.0
        y = None if i % 17 == 0 else math.inf if i % 19 == 0 else 2 * a + (5 if b is not None and b != 0.0 else 0) + rng.uniform(-0.1, 0.1)
        out.append((i, a, b, c, y))
    return out


def table(spark, values):
    return spark.createDataFrame(values, "i int, a double, b double, c double, y double").repartition(3)


def plain(values, rounds, bins, rate):
    """Stumps by exhaustive search over the same edges."""
    known = [v for v in values if v[4] is not None and math.isfinite(v[4])]
    y = [math.floor(v[4] * 1e6 + 0.5) for v in known]
    base = math.floor(sum(y) / len(y) + 0.5)
    left = [v - base for v in y]
    edges = []
    for f in (1, 2, 3):
        there = [v[f] for v in known if v[f] is not None and math.isfinite(v[f])]
        lo, hi = min(there), max(there)
        edges.append([lo + (hi - lo) * k / bins for k in range(1, bins)])
    right_of = lambda v, f, e: v[f + 1] is not None and (math.isnan(v[f + 1]) or v[f + 1] >= e)
    stumps = []
    for _ in range(rounds):
        best = None
        for f in range(3):
            for e in edges[f]:
                side = [right_of(v, f, e) for v in known]
                nr = sum(side)
                if nr in (0, len(known)):
                    continue
                sr = sum(x for x, s in zip(left, side) if s)
                sl, nl = sum(left) - sr, len(known) - nr
                gain = float(sl) * float(sl) / nl + float(sr) * float(sr) / nr
                if best is None or gain > best[0]:
                    best = (gain, f, e, math.floor(rate * (sl / nl) + 0.5), math.floor(rate * (sr / nr) + 0.5))
        _, f, e, low, high = best
        stumps.append(("abc"[f], e, low, high))
        left = [x - (high if right_of(v, f, e) else low) for x, v in zip(left, known)]
    return base, stumps


def test_fit_equals_exhaustive_search(spark):
    values = rows(300)
    model = R.fit(table(spark, values), "y", ("a", "b", "c"), rounds=6, bins=8, rate=0.7)
    base, stumps = plain(values, 6, 8, 0.7)
    assert model.base == base and [(s.feature, s.edge, s.left, s.right) for s in model.stumps] == stumps
    assert model == R.fit(table(spark, values[::-1]).repartition(7), "y", ("a", "b", "c"), rounds=6, bins=8, rate=0.7)


def test_reloaded_model_predicts_the_same(spark, tmp_path):
    df = table(spark, rows(400))
    model = R.fit(df, "y", ("a", "b", "c"), rounds=30)
    path = str(tmp_path / "model")
    R.save(spark, model, path)
    assert R.load(spark, path, ("a", "b", "c")) == model
    got = R.with_saved_model(df, path, ("a", "b", "c")).withColumn("own", model.prediction()).collect()
    assert all(r.raw_prediction == r.own and r.model_error is None and r.prediction_error_type is None for r in got) and len(got) == 400
    known = [r for r in got if r.y is not None and math.isfinite(r.y)]
    mean = sum(r.y for r in known) / len(known)
    assert sum((r.y - r.own) ** 2 for r in known) < 0.05 * sum((r.y - mean) ** 2 for r in known)
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        R.save(spark, model, path)


def test_few_rows_and_constant_columns(spark):
    one = table(spark, [(1, 2.0, None, 3.0, 7.5)])
    model = R.fit(one, "y", ("a", "b", "c"))
    assert (model.base, model.stumps) == (7_500_000, ()) and one.select(model.prediction()).first()[0] == 7.5
    for none in ([], [(1, 1.0, 1.0, 1.0, None)]):
        with pytest.raises(ValueError, match="no row has a target"):
            R.fit(table(spark, none), "y", ("a", "b", "c"))


def test_what_cannot_be_loaded_is_a_row_error(spark, tmp_path):
    df = table(spark, rows(5))
    good = R.Regressor(("a",), 5, (R.Stump("a", 0.5, 1, 2),))
    R.save(spark, good, str(tmp_path / "good"))
    spark.createDataFrame([(good.text(), "0" * 64)], "model string, sha256 string").write.parquet(str(tmp_path / "changed"))
    import hashlib

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for name, text in (("odd", '{"columns": 3}'), ("junk", "no json")):
        spark.createDataFrame([(text, digest(text))], "model string, sha256 string").write.parquet(str(tmp_path / name))
    spark.createDataFrame([(good.text(), digest(good.text()))] * 2, "model string, sha256 string").write.parquet(str(tmp_path / "two"))
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.parquet").write_bytes(b"no parquet")
    cases = {"none": "Pipeline not found", "changed": "SHA-256 mismatch", "odd": "no model in it", "junk": "no model in it", "two": "2 models", "broken": "can't be read"}
    for name, text in cases.items():
        with pytest.raises(ModelLoadError, match=r"\[XGBoost\] Model load failed: " + text):
            R.load(spark, str(tmp_path / name))
        got = R.with_saved_model(df, str(tmp_path / name)).collect()
        assert len(got) == 5 and {(r.raw_prediction, r.prediction_error_type) for r in got} == {(None, "ModelLoadError")} and all(r.model_error.startswith(text) for r in got)
    with pytest.raises(ModelLoadError, match="other columns"):
        R.load(spark, str(tmp_path / "good"), ("b",))


def test_runs_with_a_saved_model(spark, sf_dir, tmp_path):
    """A run's loss is the model's; without the model every run that gets so far fails to load it."""
    path = str(tmp_path / "model")
    R.save(spark, R.fit(queries._measured(spark, sf_dir), "measured", rounds=5), path)
    base = adapters.runs(spark, sf_dir).withColumns({c: F.lit(None).cast("string") for c in ("image_error", "detection_error", "classification_error")}).withColumn("weather_crashed", F.lit(False))
    fitted = pipeline.run(base, predictor=path).where("status = 'SUCCESS'").select("run_id", "efficiency_loss_pct")
    want = {r.run_id: min(max(r.raw_prediction, 0.0), 100.0) for r in R.with_saved_model(queries._features(spark, sf_dir), path).collect()}
    got = fitted.collect()
    assert got and all(want[r.run_id] == r.efficiency_loss_pct for r in got)
    missing = pipeline.run(base, predictor=str(tmp_path / "none")).groupBy("error_stage", "error_type", "error_message").count().collect()
    assert not [r for r in missing if r.error_stage == "none"]
    (failed,) = [r for r in missing if r.error_stage == "predict"]
    assert (failed.error_type, failed.error_message) == ("ModelLoadError", "[XGBoost] Model load failed: Pipeline not found at configured path.") and failed["count"] == len(got)
