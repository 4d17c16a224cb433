"""Images as rows: files, what their first bytes say, and decoded pixels with the models' inputs made of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelwright.settings import DEFAULT, Settings

if TYPE_CHECKING:
    import numpy as np

# What is wrong with an image.
NO_IMAGE = "No image source provided. Pass a file path (str/Path) or raw bytes."
EMPTY_IMAGE = "Image byte buffer is empty. Upload a non-empty image file."
BAD_IMAGE = ("Could not decode image from byte buffer: ", ". Upload a valid image file (e.g. PNG or JPEG).")

#: Bytes of pixels that a task makes before it hands them on.
FLUSH_BYTES = 32 << 20
PARTS = ("pixels", "detector", "classifier")
#: Bytes that an Arrow batch of images has, about, whatever the number of rows.
BATCH_BYTES = 16 << 20


def image_files(spark: SparkSession, path: str, pattern: str = "*.{png,jpg,jpeg}") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def signature_error(content: str = "content") -> Column:
    """What is wrong with an image by its first bytes; null for PNG and JPEG."""
    head = F.hex(F.substring(F.col(content), 1, 8))
    return (
        F.when(F.col(content).isNull() | (F.length(content) == 0), "no image data")
        .when(~(head.startswith("89504E470D0A1A0A") | head.startswith("FFD8FF")), "not a PNG or JPEG image")
    )


def png_size(content: str = "content") -> Column:
    """``width`` and ``height`` as a PNG's header has them, without decoding; null for anything else."""
    number = lambda at: F.conv(F.hex(F.substring(F.col(content), at, 4)), 16, 10).cast("long")
    is_png = F.hex(F.substring(F.col(content), 1, 8)) == "89504E470D0A1A0A"
    return F.when(is_png & (F.length(content) >= 24), F.struct(number(17).alias("width"), number(21).alias("height")))


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_BYTES if they are larger: by rows alone a task would hold as many as it has, up to 10,000 images."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = spark.conf.get(setting).lower().removesuffix("b")
    if not found.isdigit() or not 0 < int(found) <= BATCH_BYTES:
        spark.conf.set(setting, BATCH_BYTES)


def with_parts(images: DataFrame, parts: Mapping[str, tuple[str, Callable[[np.ndarray], Any]]], content: str = "content", image: str = "image") -> DataFrame:
    """Adds the struct ``image``: ``ok``, ``error``, ``width``, ``height`` and the ``parts``, each a type and what makes it of the RGB bytes.

    An image is decoded once for all parts. A bad image is a row with an error and without parts; null and empty contents are
    errors, too, and so is a ValueError of a part, which keeps the size. All other columns stay.
    """
    small_batches(images.sparkSession)
    names = images.columns
    at = names.index(content)
    fields = StructType.fromDDL("ok boolean, error string, width int, height int" + "".join(f", {name} {kind}" for name, (kind, _) in parts.items()))
    makers = {name: make for name, (_, make) in parts.items()}

    def looked_at(data: bytes | None) -> dict:
        from panelwright.functions.raster import decoded

        if not data:
            return {"ok": False, "error": NO_IMAGE if data is None else EMPTY_IMAGE}
        try:
            rgb = decoded(data)
        except ValueError as problem:
            return {"ok": False, "error": str(problem).join(BAD_IMAGE)}
        found = {"ok": True, "width": rgb.shape[1], "height": rgb.shape[0]}
        try:
            return found | {name: make(rgb) for name, make in makers.items()}
        except ValueError as problem:
            return found | {"ok": False, "error": str(problem)}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(fields)
        for batch in batches:
            rows, size, start = [], 0, 0
            for i, data in enumerate(batch.column(at)):
                rows.append(looked_at(data.as_py()))
                size += sum(len(v) for v in rows[-1].values() if isinstance(v, bytes))
                if size >= FLUSH_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(start, len(rows))
                    yield pa.record_batch([*part.columns, pa.array(rows, kind)], [*names, image])
                    rows, size, start = [], 0, i + 1

    return images.mapInArrow(run, StructType([*images.schema.fields]).add(image, fields))


def prepared(images: DataFrame, *parts: str, content: str = "content", image: str = "image", s: Settings = DEFAULT) -> DataFrame:
    """Adds the struct ``image`` with those of ``pixels``, ``detector`` and ``classifier`` asked for, as RGB bytes, line by line.

    These are the whole image, the square for the detector (letterboxed) and the one for the classifier (cropped). An image
    too narrow to be scaled has an error.
    """
    from panelwright.functions import raster

    if unknown := set(parts) - set(PARTS):
        raise ValueError(f"no such parts: {sorted(unknown)}")
    sides = {"detector": (raster.letterboxed, s.detector_size), "classifier": (raster.center_cropped, s.classifier_size)}

    def maker(part: str) -> Callable:
        if part not in sides:
            return lambda rgb: rgb.tobytes()
        scale, side = sides[part]
        return lambda rgb: scale(rgb, side).tobytes()

    return with_parts(images, {p: ("binary", maker(p)) for p in parts}, content, image)


def encoded(images: DataFrame, content: str = "content") -> DataFrame:
    """PNG bytes in place of ``samples`` (array of int, 8-bit), made of them, ``width``, ``height``, ``colour`` (the format's number),
    ``palette`` (binary) and ``first_filter``; the lines take the five filters in turn. Batches are of BATCH_BYTES, see ``small_batches``."""
    small_batches(images.sparkSession)
    names = images.columns
    kept = [c for c in names if c != "samples"]
    place = {c: names.index(c) for c in ("width", "height", "colour", "palette", "samples", "first_filter")}

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from panelwright.functions.raster import encode_png

        for batch in batches:
            made = []
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i] for c, k in place.items()}
                width, height, colour, first = (row[c].as_py() for c in ("width", "height", "colour", "first_filter"))
                samples = row["samples"].values.to_numpy().astype(np.uint8).reshape(height, width, -1)
                made.append(encode_png(samples, colour, (np.arange(height) + first) % 5, row["palette"].as_py() or b""))
            yield pa.record_batch([*(batch.column(names.index(c)) for c in kept), pa.array(made, pa.binary())], [*kept, content])

    return images.mapInArrow(run, StructType([images.schema[c] for c in kept]).add(content, "binary"))
