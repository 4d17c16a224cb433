"""Media columns: payloads as lossless 8-bit grey PNG images in content-addressed tar shards.

A row of the table carries the digest, and the shard, offset and length at which its image stands.
Each task writes shards of its own with every payload once; across tasks the smallest place of a
digest is the one that counts, so equal payloads share one image. Readers fetch byte ranges: the
first bytes of an image give the metadata columns, the whole range gives the samples back.

Shards go through ``pyarrow.fs``, so the shared folder may be any file system that Spark's own
files can be on. A task that is run again writes new files; rows only ever name finished ones.
"""

from __future__ import annotations

import hashlib
import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import stored, table, work_dir

UNIT = 64
SHARD_BYTES = 256 << 20
#: Rows after which a task closes its shard, however few bytes they took: repeated payloads take none.
SHARD_ROWS = 100_000
LEVEL = 6
PNG = b"\x89PNG\r\n\x1a\n"
TAR_BLOCK = 512
#: Signature and header chunk: what a reader of metadata fetches.
HEADER_BYTES = len(PNG) + 8 + 13 + 4


def padded(text: bytes | None) -> bytes:
    """The text and zeros up to a positive multiple of UNIT."""
    raw = text or b""
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A grey image, UNIT samples wide, one sample a byte, unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(start: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from an image's first HEADER_BYTES."""
    if start[: len(PNG)] != PNG or start[12:16] != b"IHDR":
        raise ValueError("no PNG image")
    return struct.unpack(">IIBB", start[16:26])


def from_png(image: bytes) -> bytes:
    """The samples of an image that ``to_png`` made; checks every chunk's sum."""
    width, height, depth, colour = png_header(image)
    if (depth, colour) != (8, 0):
        raise ValueError("not 8-bit grey")
    at, packed = len(PNG), []
    while at < len(image):
        (size,) = struct.unpack_from(">I", image, at)
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", image, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError("damaged image")
        if kind == b"IDAT":
            packed.append(data)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Size, mean, spread and entropy of the samples, and the share of padding-like zeros."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n = len(payload)
    values = np.arange(256)
    mean = float(counts @ values) / n
    spread = math.sqrt(max(0.0, float(counts @ (values * values)) / n - mean * mean))
    p = counts[counts > 0] / n
    return f"{UNIT}x{n // UNIT} mean={mean:.4f} sd={spread:.4f} entropy={float(-(p * np.log2(p)).sum()):.4f} zeros={counts[0] / n:.4f}"


def _tar_header(name: str, size: int) -> bytes:
    import tarfile

    info = tarfile.TarInfo(name)
    info.size = size
    return info.tobuf(tarfile.USTAR_FORMAT)


class ShardWriter:
    """Tar files in ``folder``; ``add`` returns where a payload stands. A payload is written once."""

    def __init__(self, folder: str):
        self.folder, self.stream, self.at, self.shard = folder, None, 0, ""
        self.places: dict[str, tuple[str, int, int]] = {}

    def add(self, digest: str, payload: bytes) -> tuple[str, int, int]:
        if (place := self.places.get(digest)) is None:
            if self.stream is None:
                system, path = fs.FileSystem.from_uri(self.folder)
                self.shard = f"{uuid.uuid4().hex}.tar"
                self.stream, self.at = system.open_output_stream(f"{path}/{self.shard}"), 0
            image = to_png(payload)
            self.stream.write(_tar_header(f"{digest}.png", len(image)))
            self.stream.write(image)
            self.stream.write(bytes(-len(image) % TAR_BLOCK))
            place = (self.shard, self.at + TAR_BLOCK, len(image))
            self.at += TAR_BLOCK + len(image) + -len(image) % TAR_BLOCK
            self.places[digest] = place
        return place

    def close(self) -> None:
        """Places of a finished file are dropped, so what is remembered is bounded by a file."""
        if self.stream is not None:
            self.stream.write(bytes(2 * TAR_BLOCK))
            self.stream.close()
        self.stream, self.places = None, {}


def write_media(docs: DataFrame, folder: str) -> DataFrame:
    """Writes every whole text's payload below ``folder``; returns the stored table of places.

    ``doc_id``, ``n_bytes`` (unpadded), ``digest`` (SHA-256 of the payload), ``shard``, ``offset``,
    ``length``. Null and empty texts give UNIT zeros. One row per input row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ShardWriter(folder)
        rows: list[tuple] = []
        ids: list[pa.Array] = []

        def finished() -> pa.RecordBatch:
            """Rows only leave once the file that they name is closed."""
            writer.close()
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
            out = pa.record_batch([pa.chunked_array(ids).combine_chunks(), *columns], names)
            rows.clear()
            ids.clear()
            return out

        for batch in batches:
            ids.append(batch.column(0))
            for t in batch.column(1).cast(pa.binary()):
                raw = t.as_py() or b""
                payload = padded(raw)
                digest = hashlib.sha256(payload).hexdigest()
                rows.append((len(raw), digest, *writer.add(digest, payload)))
            if rows and (writer.at > SHARD_BYTES or len(rows) >= SHARD_ROWS):
                yield finished()
        if rows:
            yield finished()

    names = ["doc_id", "n_bytes", "digest", "shard", "offset", "length"]
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(
        docs.select("doc_id", "text").mapInArrow(
            run, f"doc_id {kind}, n_bytes long, digest string, shard string, offset long, length long"
        ),
        "places",
    )


def places_of(media: DataFrame) -> DataFrame:
    """One place for each digest: the smallest."""
    return media.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.*")


class RangeReader:
    """Byte ranges of shards, one open file at a time."""

    def __init__(self, folder: str):
        self.system, self.path = fs.FileSystem.from_uri(folder)
        self.shard, self.file = "", None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.shard:
            self.shard, self.file = shard, self.system.open_input_file(f"{self.path}/{shard}")
        found = self.file.read_at(length, offset)
        if len(found) != length:
            raise ValueError("shard ends early")
        return found


def media_headers(places: DataFrame, folder: str) -> DataFrame:
    """``digest``, ``width``, ``height``, ``depth``: reads each image's header bytes only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader(folder)
        for batch in batches:
            rows = batch.to_pylist()
            heads = [png_header(reader.read(r["shard"], r["offset"], min(HEADER_BYTES, r["length"]))) for r in rows]
            yield pa.record_batch(
                [batch.column(0), *(pa.array([h[i] for h in heads], pa.int64()) for i in range(3))],
                ["digest", "width", "height", "depth"],
            )

    return places.select("digest", "shard", "offset", "length").mapInArrow(
        run, "digest string, width long, height long, depth long"
    )


def media_features(places: DataFrame, folder: str) -> DataFrame:
    """Reads each image back: ``payload_bytes``, ``payload_sha256``, ``tail_crc32``, ``media_bytes``, ``media_sha256``, ``feature``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader(folder)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                image = reader.read(r["shard"], r["offset"], r["length"])
                payload = from_png(image)
                out.append((
                    r["digest"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]),
                    len(image), hashlib.sha256(image).hexdigest(), feature(payload),
                ))
            names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return places.select("digest", "shard", "offset", "length").mapInArrow(
        run,
        "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string",
    )


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Stores every whole text, reads it back, and returns one row per input row with place, metadata and features.

    Equal texts have equal values. Ids don't matter: rows that repeat one or have none come out each; nor do other columns. The shards stay in ``folder`` (below the shared folder if not given).
    """
    folder = folder or work_dir(docs.sparkSession, "media")
    media = write_media(docs, folder)
    places = stored(places_of(media).repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset"), "canon")
    found = media_headers(places, folder).join(media_features(places, folder), "digest")
    return (
        media.select("doc_id", "n_bytes", "digest")
        .join(places, "digest")
        .join(found, "digest")
        .select(
            "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
            "feature", "width", "height",
        )
    )


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
