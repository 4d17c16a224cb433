"""One image at a time, in numpy: PNG to RGB and back, and bilinear resampling. What runs it over tables is in ``sources.images``."""

from __future__ import annotations

import struct
import zlib

import numpy as np

PNG = b"\x89PNG\r\n\x1a\n"
JPEG = b"\xff\xd8\xff"
#: Samples of a pixel by colour type, bit depths a colour type may have, first place and step of the interlaced passes.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: More than this is refused before anything is unpacked.
MAX_PIXELS = 178_956_970
#: Bits after the point of a weight.
WEIGHT_BITS = 22


def _chunks(content: bytes) -> tuple[bytes, bytes, bytes]:
    """Header, palette and packed samples; every chunk's sum is checked."""
    at, head, palette, packed = len(PNG), b"", b"", []
    while True:
        if at + 12 > len(content):
            raise ValueError("image file is truncated")
        (size,) = struct.unpack_from(">I", content, at)
        kind, end = content[at + 4 : at + 8], at + 8 + size
        if end + 4 > len(content):
            raise ValueError("image file is truncated")
        data = content[at + 8 : end]
        if struct.unpack_from(">I", content, end)[0] != zlib.crc32(kind + data):
            raise ValueError("broken chunk")
        if kind == b"IHDR":
            head = data
        elif kind == b"PLTE":
            palette = data
        elif kind == b"IDAT":
            packed.append(data)
        elif kind == b"IEND":
            break
        at = end + 4
    if len(head) != 13 or not packed:
        raise ValueError("incomplete image")
    return head, palette, b"".join(packed)


def unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Bytes of lines from filtered ones, whose first byte names the filter; ``step`` is the bytes of a pixel.

    A byte needs the ones to the left, above and to the upper left. Where a line uses the average or the nearest of
    these, all lines are solved together, one diagonal at a time.
    """
    kinds, rest = lines[:, 0], lines[:, 1:].reshape(len(lines), -1, step)
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    height, width = rest.shape[:2]
    out = np.zeros((height + 1, width + 1, step), np.uint8)
    if kinds.max(initial=0) < 3:
        for y in range(height):
            line = np.add.accumulate(rest[y], axis=0, dtype=np.uint8) if kinds[y] == 1 else rest[y]
            out[y + 1, 1:] = line + out[y, 1:] if kinds[y] == 2 else line
        return out[1:, 1:].reshape(height, -1)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, up, corner = (out[y + i, x + j].astype(np.int16) for i, j in ((1, 0), (0, 1), (0, 0)))
        guess = left + up - corner
        by_left, by_up, by_corner = abs(guess - left), abs(guess - up), abs(guess - corner)
        nearest = np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))
        base = np.choose(kinds[y][:, None], [np.zeros_like(left), left, up, (left + up) >> 1, nearest])
        out[y + 1, x + 1] = (rest[y, x] + base).astype(np.uint8)
    return out[1:, 1:].reshape(height, -1)


def _samples(data: bytes, width: int, height: int, depth: int, channels: int) -> tuple[np.ndarray, int]:
    """Samples (height, width, channels) as stored, 16-bit ones by their upper byte, and the bytes used up."""
    stride = (width * channels * depth + 7) // 8
    if len(data) < height * (stride + 1):
        raise ValueError("image file is truncated")
    lines = np.frombuffer(data, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    flat = unfiltered(lines, max(1, channels * depth // 8))
    if depth == 16:
        flat = flat[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(flat, axis=1).reshape(height, -1, depth)
        flat = np.packbits(bits, axis=2)[:, :, 0] >> (8 - depth)
    return flat[:, : width * channels].reshape(height, width, channels), lines.size


def decode_png(content: bytes) -> np.ndarray:
    """RGB bytes (height, width, 3) of a PNG image; transparency is left out. ValueError says what is wrong with it."""
    head, palette, packed = _chunks(content)
    width, height, depth, colour, packing, filtering, interlaced = struct.unpack(">IIBBBBB", head)
    if depth not in DEPTHS.get(colour, ()) or packing or filtering or interlaced > 1:
        raise ValueError("unknown kind of image")
    if not width or not height:
        raise ValueError("image without pixels")
    if width * height > MAX_PIXELS:
        raise ValueError("too many pixels")
    channels = CHANNELS[colour]
    passes = ADAM7 if interlaced else ((0, 0, 1, 1),)
    sizes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in passes]
    most = sum(h * ((w * channels * depth + 7) // 8 + 1) for w, h in sizes if w > 0 and h > 0)
    try:
        data = zlib.decompressobj().decompress(packed, most)
    except zlib.error as problem:
        raise ValueError("damaged samples") from problem
    found = np.zeros((height, width, channels), np.uint8)
    at = 0
    for (x, y, dx, dy), (w, h) in zip(passes, sizes):
        if w > 0 and h > 0:
            found[y::dy, x::dx], used = _samples(data[at:], w, h, depth, channels)
            at += used
    if colour == 3:
        table = np.zeros((256, 3), np.uint8)
        entries = np.frombuffer(palette[: len(palette) // 3 * 3], np.uint8).reshape(-1, 3)
        if not len(entries):
            raise ValueError("image without palette")
        table[: len(entries)] = entries[:256]
        return table[found[:, :, 0]]
    if colour == 0 and depth < 8:
        found = found * np.uint8(255 // ((1 << depth) - 1))
    return np.repeat(found[:, :, :1], 3, axis=2) if channels < 3 else np.ascontiguousarray(found[:, :, :3])


def decoded(content: bytes) -> np.ndarray:
    """RGB bytes of an image. JPEG needs Pillow, where that is installed."""
    if content[: len(PNG)] == PNG:
        return decode_png(content)
    if content[: len(JPEG)] != JPEG:
        raise ValueError("cannot identify image file")
    try:
        from PIL import Image
    except ImportError as problem:
        raise ValueError("no decoder for JPEG") from problem
    import io

    try:
        return np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))
    except (OSError, Image.DecompressionBombError) as problem:
        raise ValueError(str(problem)) from problem


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: np.ndarray, colour: int, filters: np.ndarray, palette: bytes = b"") -> bytes:
    """8-bit samples (height, width, channels) as PNG, each line with the filter given for it."""
    height, width, step = samples.shape
    around = np.zeros((height + 1, width + 1, step), np.int16)
    around[1:, 1:] = samples
    left, up, corner = around[1:, :-1], around[:-1, 1:], around[:-1, :-1]
    guess = left + up - corner
    distance = np.abs(guess - np.stack([left, up, corner]))
    nearest = np.take_along_axis(np.stack([left, up, corner]), distance.argmin(0)[None], 0)[0]
    base = np.choose(filters[:, None, None], [np.zeros_like(left), left, up, (left + up) >> 1, nearest])
    lines = np.empty((height, 1 + width * step), np.uint8)
    lines[:, 0] = filters
    lines[:, 1:] = (samples - base).astype(np.uint8).reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    extra = _chunk(b"PLTE", palette) if palette else b""
    return PNG + _chunk(b"IHDR", head) + extra + _chunk(b"IDAT", zlib.compress(lines.tobytes())) + _chunk(b"IEND", b"")


def _taps(size: int, out: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (out, k) and whole-numbered weights of the samples that each of ``out`` new ones is made of.

    A triangle as wide as two old samples, or two new ones if these are larger; weights add up to one and are
    rounded to WEIGHT_BITS.
    """
    scale = size / out
    wide = max(scale, 1.0)
    centre = (np.arange(out) + 0.5) * scale
    first = np.maximum((centre - wide + 0.5).astype(np.int64), 0)
    last = np.minimum((centre + wide + 0.5).astype(np.int64), size)
    at = first[:, None] + np.arange((last - first).max())
    weight = np.maximum(1.0 - np.abs((at - centre[:, None] + 0.5) * (1.0 / wide)), 0.0) * (at < last[:, None])
    weight = weight * (1.0 / np.cumsum(weight, axis=1)[:, -1:])
    return np.minimum(at, size - 1), np.floor(0.5 + weight * (1 << WEIGHT_BITS)).astype(np.int32)


def _along(pixels: np.ndarray, out: int, axis: int) -> np.ndarray:
    """Resampled along an axis; rounded to bytes."""
    at, weight = _taps(pixels.shape[axis], out)
    shape = list(pixels.shape)
    shape[axis] = out
    total = np.full(shape, 1 << (WEIGHT_BITS - 1), np.int32)
    beside = (-1, 1, 1) if axis == 0 else (1, -1, 1)
    for k in range(at.shape[1]):
        total += np.take(pixels, at[:, k], axis=axis) * weight[:, k].reshape(beside)
    total >>= WEIGHT_BITS
    return np.clip(total, 0, 255, out=total).astype(np.uint8)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, with as wide a window as the reduction asks for: along lines first, then along columns."""
    if width < 1 or height < 1:
        raise ValueError("height and width must be > 0")
    if width != pixels.shape[1]:
        pixels = _along(pixels, width, 1)
    if height != pixels.shape[0]:
        pixels = _along(pixels, height, 0)
    return pixels


def letterboxed(pixels: np.ndarray, size: int, background: int = 114) -> np.ndarray:
    """Fitted into a square: the shorter side is cut off to whole pixels, what is left over is grey."""
    height, width = pixels.shape[:2]
    ratio = width / height
    new_w, new_h = (size, int(size / ratio)) if ratio > 1 else (int(size * ratio), size)
    out = np.full((size, size, 3), background, np.uint8)
    x, y = (size - new_w) // 2, (size - new_h) // 2
    out[y : y + new_h, x : x + new_w] = resized(pixels, new_w, new_h)
    return out


def center_cropped(pixels: np.ndarray, size: int) -> np.ndarray:
    """The middle square after scaling the shorter side. That side may come out a pixel short: the square then begins outside, in black."""
    height, width = pixels.shape[:2]
    ratio = size / min(width, height)
    small = resized(pixels, int(width * ratio), int(height * ratio))
    x, y = (small.shape[1] - size) // 2, (small.shape[0] - size) // 2
    out = np.zeros((size, size, 3), np.uint8)
    part = small[max(y, 0) : y + size, max(x, 0) : x + size]
    out[max(-y, 0) :, max(-x, 0) :][: part.shape[0], : part.shape[1]] = part
    return out
