"""Array expressions for model outputs: scores, boxes, pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelwright.functions.numeric import finite


def softmax(logits: Column) -> Column:
    """Probabilities in double precision; the largest logit is subtracted first."""
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def argmax(values: Column) -> Column:
    """Index of the first maximum; null of an empty array."""
    place = F.array_position(values, F.array_max(values))
    return F.when(F.size(values) > 0, (place - 1).cast("int"))


def label_of(index: Column, labels: Sequence[str], unknown: str = "Unknown") -> Column:
    names = F.array(*[F.lit(x) for x in labels])
    return F.coalesce(F.when(index >= 0, F.get(names, index)), F.lit(unknown))


def by_label(values: Column, labels: Sequence[str]) -> Column:
    """Map of label to value, as long as the shorter of the two."""
    names = F.array(*[F.lit(x) for x in labels])
    n = F.least(F.size(values), F.lit(len(labels)))
    return F.map_from_arrays(F.slice(names, F.lit(1), n), F.slice(values, F.lit(1), n))


def probability_error(p: Column) -> Column:
    """The first thing wrong with class probabilities; null if nothing is."""
    best = F.array_max(p)
    return (
        F.when(F.exists(p, lambda x: ~finite(x)), "non-finite values")
        .when(F.exists(p, lambda x: x < 0), "negative values")
        .when(~finite(best), "confidence non-finite")
        .when((best < 0) | (best > 1), "confidence out of range [0,1]")
    )


def box_error(box: Column, confidence: Column) -> Column:
    """The first thing wrong with one box; null if nothing is."""
    return (
        F.when(F.exists(box, lambda v: ~finite(v)), "non-finite coordinates")
        .when(~finite(confidence), "confidence non-finite")
        .when((confidence < 0) | (confidence > 1), "confidence out of range [0,1]")
    )


def first_box_error(boxes: Column, confidences: Column) -> Column:
    """The first faulty box's error, in order; zips to the shorter array."""
    n = F.least(F.size(boxes), F.size(confidences))
    errors = F.zip_with(
        F.slice(boxes, F.lit(1), n), F.slice(confidences, F.lit(1), n), lambda b, c: box_error(b, c)
    )
    return F.get(F.filter(errors, lambda e: e.isNotNull()), F.lit(0))


def normalised(pixels: Column, mean: float, std: float) -> Column:
    """Bytes to [0, 1], then centred and scaled, one channel."""
    return F.transform(pixels, lambda v: (v / F.lit(255.0) - F.lit(mean)) / F.lit(std))
