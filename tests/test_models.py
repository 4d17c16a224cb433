"""Injected models: loading, errors of single rows, images through both models, suppression of boxes."""

import math
import os
import random
import sys

import numpy as np
import pytest
from panelwright import errors
from panelwright.functions import raster as R
from panelwright.operators import models as M
from panelwright.operators import prediction, vision
from panelwright.plans.queries import QUERIES, BrightCells, ChannelMoments
from panelwright.settings import LABELS, MODEL_COLUMNS, Settings
from panelwright.sources import adapters
from pyspark import cloudpickle
from pyspark.sql import functions as F

# workers can't import this file
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def frame(spark, values, parts=4):
    rows = [(i, *([float(v)] * len(MODEL_COLUMNS))) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "run_id int, " + ", ".join(f"{c} double" for c in MODEL_COLUMNS)).repartition(parts)


class Doubling:
    def __init__(self, log=None):
        if log:
            with open(f"{log}/{os.getpid()}", "a") as f:
                f.write("x")

    def predict(self, features):
        if (features["humidity_pct"] == 7).any():
            raise RuntimeError("seven isn't liked")
        return [None if v == 5 else "text" if v == 6 else 2 * v for v in features["humidity_pct"]]


def test_a_bad_row_fails_alone(spark):
    got = {r.run_id: r for r in prediction.predicted(frame(spark, [*range(20), 7, math.nan]), Doubling).collect()}
    assert len(got) == 22
    for i, v in enumerate([*range(20), 7]):
        if v == 7:
            assert (got[i].raw_prediction, got[i].error_type, got[i].error) == (None, "PredictionError", "seven isn't liked")
        elif v in (5, 6):
            assert got[i].error_type == "PredictionError" and got[i].error.startswith("Invalid prediction output: ")
        else:
            assert (got[i].raw_prediction, got[i].error_type, got[i].error) == (2.0 * v, None, None)
    assert math.isnan(got[21].raw_prediction) and got[21].error is None


def test_a_model_that_cannot_be_loaded_is_an_error_of_every_row(spark):
    def load():
        raise FileNotFoundError("weights/none.joblib isn't there")

    got = prediction.predicted(frame(spark, range(9)), load).collect()
    assert {(r.raw_prediction, r.error_type, r.error) for r in got} == {(None, "ModelLoadError", "weights/none.joblib isn't there")} and len(got) == 9
    with pytest.raises(errors.ModelLoadError, match=r"\[YOLO\] Model load failed: no model has been set"):
        M.Model("YOLO", None)


def test_a_model_is_loaded_once_a_process(spark, tmp_path):
    folder = str(tmp_path)
    model = M.Model("XGBoost", lambda: Doubling(folder))
    for _ in range(2):
        got = prediction.predicted(frame(spark, [1.0] * 40, 20), model)
        assert got.where("raw_prediction = 2").count() == 40
    loads = {f: len(open(f"{folder}/{f}").read()) for f in os.listdir(folder)}
    assert loads and set(loads.values()) == {1} and len(loads) <= 8


def test_loading_on_the_driver():
    calls = []
    good, bad = M.Model("a", lambda: calls.append(1) or "model"), M.Model("b", lambda: None)
    assert M.loaded_models([good, bad]) == {"a": False, "b": False}
    M.preload([good])
    assert good.get() == "model" and calls == [1] and M.loaded_models([good, bad]) == {"a": True, "b": False}
    for _ in range(2):
        with pytest.raises(errors.ModelLoadError, match=r"\[b\] Model load failed: the loader gives no model"):
            M.preload([good, bad])


def test_wrong_number_of_outputs():
    assert [e for _, e in M.each_row(lambda rows: [1, 2, 3], [1, 2])] == ["3 outputs for 1 rows"] * 2
    assert list(M.each_row(lambda rows: [x for x in rows], [])) == []


def iou(a, b):
    w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union else 0.0


def plain_nms(boxes, confidences, ids, conf=0.45, limit=0.5):
    rows = [(c, i) for i, (_, c, _) in enumerate(zip(boxes, confidences, ids)) if c is not None and not math.isnan(c) and c > conf]
    kept = []
    for _, i in sorted(rows, key=lambda r: (-r[0], r[1])):
        if not any(ids[k] == ids[i] and iou(boxes[k], boxes[i]) > limit for k in kept):
            kept.append(i)
    return kept


def test_suppression_equals_a_loop(spark):
    rng = random.Random(6)
    rows = []
    for k in range(60):
        n = rng.choice([0, 1, 2, 30])
        boxes = [[x, y, x + rng.randrange(0, 40), y + rng.randrange(0, 40)] for x, y in ((rng.randrange(30), rng.randrange(30)) for _ in range(n))]
        confidences = [rng.choice([0.45, 0.46, 0.9, 1.0, rng.random(), math.nan, None]) for _ in range(n)]
        rows.append((k, [list(map(float, b)) for b in boxes], confidences, [rng.randrange(2) for _ in range(n)]))
    rows.append((100, [[0.0, 0.0, 10.0, 10.0]] * 3, [0.5, 0.9], [0, 0, 0]))
    rows.append((101, [[math.nan, 0.0, 1.0, 1.0], [math.nan, 0.0, 1.0, 1.0], [0.0, 0.0, math.inf, 5.0]], [0.9, 0.8, 0.7], [0, 0, 0]))
    df = spark.createDataFrame(rows, "k int, boxes array<array<double>>, confidences array<double>, class_ids array<int>")
    found = {r.k: r.kept for r in df.select("k", vision.suppressed(F.col("boxes"), F.col("confidences"), F.col("class_ids")).alias("kept")).collect()}
    for k, boxes, confidences, ids in rows[:-1]:
        assert [x.ord for x in found[k]] == plain_nms(boxes, confidences, ids)
        assert all((x.confidence, x.class_id) == (confidences[x.ord], ids[x.ord]) for x in found[k])
    assert [x.ord for x in found[101]] == [0, 1, 2]


def picture(seed, width=40, height=30):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 3)).astype(np.uint8)


def content(pixels):
    return R.encode_png(pixels, 2, np.zeros(len(pixels), int))


class Scripted:
    """A detector that answers by the square's first byte."""

    def __call__(self, square, conf, iou, imgsz):
        assert square.shape == (imgsz, imgsz, 3) and square.dtype == np.uint8 and (conf, iou) == (0.45, 0.5)
        kind = int(square[imgsz // 2, imgsz // 2, 0])
        if kind == 1:
            return []
        if kind == 2:
            return [([[1, 2, 3, 4]], [0.9], [0]), ([[5, 6, 7, 8], [0, 0, 1, 1]], [0.7, 0.95], [1, 2])]
        if kind == 3:
            return [([[math.nan, 0, 1, 1]], [0.9], [0])]
        if kind == 4:
            return [([[0, 0, 1, 1]], [1.5], [0])]
        raise RuntimeError("CUDA out of memory")


def test_images_through_models(spark):
    flat = [(k, content(np.full((16, 16, 3), k, np.uint8))) for k in range(1, 6)] + [(9, b"junk"), (10, None)]
    s = Settings(detector_size=16, classifier_size=8)
    seen = M.Model("MobileNet", lambda: lambda t: [float(t.mean()), 0.0] if t.dtype == np.float32 and t.shape == (3, 8, 8) else None)
    df = vision.inferred(spark.createDataFrame(flat, "k int, content binary"), M.Model("YOLO", Scripted), seen, s=s)
    df = vision.with_classification(vision.with_detection(df, F.col("image.detection")), F.col("image.classification"), s)
    got = {r.k: r for r in df.collect()}
    told = {k: (r.panel_count, r.detection_confidence, r.detection_successful, r.detection_error_type, r.detection_error) for k, r in got.items()}
    assert told[1] == (0, 0.0, False, None, None) and told[2] == (3, 0.95, True, None, None)
    assert got[2].image.detection.boxes == [[1, 2, 3, 4], [5, 6, 7, 8], [0, 0, 1, 1]] and got[2].image.detection.class_ids == [0, 1, 2]
    assert told[3] == (0, 0.0, False, "PredictionError", "non-finite coordinates") and told[4] == (0, 0.0, False, "PredictionError", "confidence out of range [0,1]")
    assert told[5] == (0, 0.0, False, "PredictionError", "CUDA out of memory")
    assert told[9][:3] == (0, 0.0, False) and told[9][3:] == (None, None) and not got[9].image.ok and not got[10].image.ok
    assert all(got[k].label in LABELS and got[k].class_id in (0, 1) and got[k].classification_error is None for k in range(1, 6))
    assert (got[9].label, got[9].class_id, got[9].class_confidence, got[9].probabilities) == ("Unknown", -1, 0.0, None)


def test_broken_classifiers(spark):
    df = spark.createDataFrame([(1, content(picture(1)))], "k int, content binary")
    s = Settings(detector_size=16, classifier_size=8)

    def missing():
        raise OSError("no weights")

    for load, kind, text in ((lambda: lambda t: [math.nan, 1.0], "PredictionError", "non-finite values"), (lambda: lambda t: [], "PredictionError", "no class scores"), (missing, "ModelLoadError", "no weights"), (lambda: lambda t: 1 / 0, "PredictionError", "division by zero")):
        r = vision.with_classification(vision.inferred(df, classifier=M.Model("MobileNet", load), s=s), F.col("image.classification"), s).first()
        assert (r.classification_error_type, r.classification_error, r.label, r.class_id) == (kind, text, "Unknown", -1)


def test_runs_from_images(spark, sf_dir):
    """Every run's stage, counts and label against the stand-ins called on plainly decoded images."""
    rows = {r.run_id: r for r in QUERIES["image_runs"](spark, sf_dir).collect()}
    inputs = {r.run_id: r for r in adapters.runs(spark, sf_dir).collect()}
    stages = set()
    checked = 0
    for image in adapters.images(spark, sf_dir).orderBy("run_id").collect():
        if image.run_id not in inputs:
            assert image.run_id not in rows
            continue
        r = rows.pop(image.run_id)
        stages.add(r.error_stage)
        try:
            if not image.content:
                raise ValueError("no bytes")
            pixels = R.decode_png(bytes(image.content)) if image.content[:8] == R.PNG else R.decoded(bytes(image.content))
        except ValueError:
            assert (r.error_stage, r.error_type, r.panel_count, r.label) == ("image", "ImageValidationError", 0, "Unknown") and r.error_message.startswith("Image validation failed: ")
            continue
        assert r.error_stage != "image"
        if checked < 12:
            (boxes, light, _), = BrightCells()(R.letterboxed(pixels, 640), conf=0.45, iou=0.5, imgsz=640)
            crop = R.center_cropped(pixels, 224).astype(np.float64) / 255
            t = ((crop - (0.485, 0.456, 0.406)) / (0.229, 0.224, 0.225)).transpose(2, 0, 1)
            scores = ChannelMoments()(t)
            assert r.panel_count == len(boxes)
            assert r.error_stage == "inputs" or r.label == LABELS[int(np.argmax(scores))]
            checked += 1
    assert not rows and {"image", "inputs"} <= stages and checked == 12
