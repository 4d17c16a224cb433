"""What stands before and after the image models: geometry, boxes, scores."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.errors import ModelLoadError
from panelwright.functions.arrays import argmax, box_error, by_label, first_box_error, label_of, probability_error, softmax
from panelwright.functions.numeric import more_than
from panelwright.operators.models import Model
from panelwright.settings import DEFAULT, IMAGE_MEAN, IMAGE_STD, Settings
from panelwright.sources.images import with_parts


def letterbox(width: Column, height: Column, s: Settings = DEFAULT) -> Column:
    """Size and offset of an image fitted into the detector's square: cut off, not rounded."""
    n = F.lit(s.detector_size)
    ratio = width / height
    w = F.when(ratio > 1, n).otherwise(F.floor(n * ratio)).cast("int")
    h = F.when(ratio > 1, F.floor(n / ratio)).otherwise(n).cast("int")
    half = lambda x: F.floor((n - x) / 2).cast("int")
    return F.struct(w.alias("new_w"), h.alias("new_h"), half(w).alias("offset_x"), half(h).alias("offset_y"))


def center_crop(width: Column, height: Column, s: Settings = DEFAULT) -> Column:
    """Size after scaling the shorter side, and the crop's corner; truncation may leave it one short, so -1."""
    n = F.lit(s.classifier_size)
    ratio = n / F.least(width, height)
    w, h = F.floor(width * ratio).cast("int"), F.floor(height * ratio).cast("int")
    half = lambda x: F.floor((x - n) / 2).cast("int")
    return F.struct(w.alias("new_w"), h.alias("new_h"), half(w).alias("left"), half(h).alias("top"))


def detection_summary(runs: DataFrame, boxes: DataFrame, key: str = "run_id") -> DataFrame:
    """Per run: ``panel_count``, ``best_confidence``, ``detection_successful``; 0, 0.0, false without a box."""
    found = boxes.groupBy(key).agg(F.count("*").alias("panel_count"), F.max("confidence").alias("best_confidence"))
    return runs.select(key).join(found, key, "left").select(
        key,
        F.coalesce("panel_count", F.lit(0)).alias("panel_count"),
        F.coalesce("best_confidence", F.lit(0.0)).alias("best_confidence"),
        (F.coalesce("panel_count", F.lit(0)) > 0).alias("detection_successful"),
    )


def detections_long(df: DataFrame, key: str = "run_id") -> DataFrame:
    """``boxes``, ``confidences``, ``class_ids`` to one row a box, as many as the shortest array has."""
    n = F.least(F.size("boxes"), F.size("confidences"), F.size("class_ids"))
    zipped = F.arrays_zip(*[F.slice(c, F.lit(1), n).alias(c) for c in ("boxes", "confidences", "class_ids")])
    return df.select(key, F.posexplode(zipped).alias("ord", "d")).select(
        key, "ord", F.col("d.boxes").alias("box"), F.col("d.confidences").alias("confidence"), F.col("d.class_ids").alias("class_id")
    )


def with_box_errors(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("error", box_error(F.col("box"), F.col("confidence")))


def classified(df: DataFrame, logits: str = "logits", s: Settings = DEFAULT) -> DataFrame:
    """Adds ``probs``, ``class_id``, ``confidence``, ``label`` and ``probabilities`` to logits."""
    return (
        df.withColumn("probs", softmax(F.col(logits)))
        .withColumn("class_id", argmax(F.col("probs")))
        .withColumn("confidence", F.array_max("probs"))
        .withColumn("label", label_of(F.col("class_id"), s.labels))
        .withColumn("probabilities", by_label(F.col("probs"), s.labels))
    )


def _overlaps(a: Column, b: Column, share: float) -> Column:
    """Whether the intersection of two boxes (x1, y1, x2, y2) is more than ``share`` of their union; false where either isn't finite."""
    side = lambda i: F.greatest(F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]), F.lit(0.0))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    both = side(0) * side(1)
    return F.coalesce(more_than(F.try_divide(both, area(a) + area(b) - both), share), F.lit(False))


def suppressed(boxes: Column, confidences: Column, class_ids: Column, s: Settings = DEFAULT) -> Column:
    """Of a model's raw boxes those that count: array of ``box``, ``confidence``, ``class_id``, ``ord`` (place in the raw list).

    Boxes whose confidence is above the threshold are gone through from the most confident one (ties: in raw order); one
    that overlaps a kept box of its class too much is dropped. Null and NaN confidences never count, missing boxes overlap nothing.
    The lists are zipped to the shortest. A fold over the arrays of one image: nothing is joined or shuffled.
    """
    n = F.least(F.size(boxes), F.size(confidences), F.size(class_ids))
    cut = lambda c: F.slice(c, F.lit(1), n)
    raw = F.arrays_zip(cut(boxes).alias("box"), cut(confidences).alias("confidence"), cut(class_ids).alias("class_id"))
    raw = F.transform(
        raw,
        lambda r, i: F.struct(
            (-r["confidence"]).alias("first"), i.alias("ord"), r["box"].alias("box"), r["confidence"].alias("confidence"), r["class_id"].alias("class_id")
        ),
    )
    ranked = F.array_sort(F.filter(raw, lambda r: F.coalesce(more_than(r["confidence"], s.detector_confidence), F.lit(False))))
    kept = F.aggregate(
        ranked,
        F.filter(ranked, lambda r: F.lit(False)),
        lambda found, r: F.when(
            F.exists(found, lambda f: (f["class_id"] == r["class_id"]) & _overlaps(f["box"], r["box"], s.detector_iou)), found
        ).otherwise(F.concat(found, F.array(r))),
    )
    return F.transform(kept, lambda r: F.struct(r["box"].alias("box"), r["confidence"].alias("confidence"), r["class_id"].alias("class_id"), r["ord"].alias("ord")))


def inferred(images: DataFrame, detector: Model | None = None, classifier: Model | None = None, content: str = "content", s: Settings = DEFAULT) -> DataFrame:
    """Adds the struct ``image`` with ``detection`` and ``classification`` by injected models; pixels never leave the Python worker.

    The detector is called with the letterboxed square (height, width, 3; bytes) and ``conf``, ``iou``, ``imgsz``; it returns
    a list of predictions, each (boxes, confidences, class ids), which are strung together. The classifier is called with the
    normalised crop (3, height, width; 32-bit floats) and returns logits. A model that can't be loaded, or fails on an image,
    leaves its ``error_type`` and ``error`` in that image's row.
    """
    from panelwright.functions import raster

    def called(model: Model, call) -> dict[str, Any]:
        try:
            found = model.get()
        except ModelLoadError as problem:
            return {"error_type": "ModelLoadError", "error": problem.reason}
        try:
            return call(found)
        except Exception as problem:
            return {"error_type": "PredictionError", "error": f"{problem}" or type(problem).__name__}

    def detect(rgb) -> dict[str, Any]:
        square = raster.letterboxed(rgb, s.detector_size)

        def call(model) -> dict[str, Any]:
            found = {"boxes": [], "confidences": [], "class_ids": []}
            for boxes, confidences, ids in model(square, conf=s.detector_confidence, iou=s.detector_iou, imgsz=s.detector_size):
                for box, confidence, number in zip(boxes, confidences, ids):
                    found["boxes"].append([float(v) for v in box])
                    found["confidences"].append(float(confidence))
                    found["class_ids"].append(int(number))
            return found

        return called(detector, call)

    def classify(rgb) -> dict[str, Any]:
        import numpy as np

        crop = raster.center_cropped(rgb, s.classifier_size).astype(np.float32) / np.float32(255)
        tensor = ((crop - np.float32(IMAGE_MEAN)) / np.float32(IMAGE_STD)).transpose(2, 0, 1)
        return called(classifier, lambda model: {"logits": [float(v) for v in model(tensor)]})

    parts = {}
    if detector is not None:
        parts["detection"] = ("struct<boxes: array<array<double>>, confidences: array<double>, class_ids: array<int>, error_type: string, error: string>", detect)
    if classifier is not None:
        parts["classification"] = ("struct<logits: array<double>, error_type: string, error: string>", classify)
    return with_parts(images, parts, content)


def with_detection(df: DataFrame, detection: Column) -> DataFrame:
    """Adds ``detection_error_type``, ``detection_error``, ``panel_count``, ``detection_confidence`` (the best) and ``detection_successful``."""
    invalid = first_box_error(detection["boxes"], detection["confidences"])
    df = df.withColumns(
        {
            "detection_error": F.coalesce(detection["error"], invalid),
            "detection_error_type": F.coalesce(detection["error_type"], F.when(invalid.isNotNull(), "PredictionError")),
        }
    )
    fine = F.col("detection_error").isNull() & detection.isNotNull()
    return df.withColumns(
        {
            "panel_count": F.when(fine, F.size(detection["boxes"])).otherwise(0),
            "detection_confidence": F.when(fine, F.coalesce(F.array_max(detection["confidences"]), F.lit(0.0))).otherwise(0.0),
            "detection_successful": fine & (F.size(detection["boxes"]) > 0),
        }
    )


def with_classification(df: DataFrame, classification: Column, s: Settings = DEFAULT) -> DataFrame:
    """Adds ``classification_error_type``, ``classification_error``, ``class_id``, ``class_confidence``, ``label`` and ``probabilities``."""
    probs = softmax(classification["logits"])
    df = df.withColumn("_probs", F.when(F.size(classification["logits"]) > 0, probs))
    empty = classification["error"].isNull() & classification.isNotNull() & F.col("_probs").isNull()
    invalid = F.coalesce(F.when(empty, "no class scores"), probability_error(F.col("_probs")))
    df = df.withColumns(
        {
            "classification_error": F.coalesce(classification["error"], F.when(classification.isNotNull(), invalid)),
            "classification_error_type": F.coalesce(classification["error_type"], F.when(invalid.isNotNull() & classification.isNotNull(), "PredictionError")),
        }
    )
    p = F.when(F.col("classification_error").isNull(), F.col("_probs"))
    return df.withColumns(
        {
            "class_id": F.coalesce(argmax(p), F.lit(-1)),
            "class_confidence": F.coalesce(F.array_max(p), F.lit(0.0)),
            "label": F.coalesce(label_of(argmax(p), s.labels), F.lit("Unknown")),
            "probabilities": by_label(p, s.labels),
        }
    ).drop("_probs")
