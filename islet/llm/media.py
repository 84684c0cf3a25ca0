"""Media in binary columns: payloads as PNG images, read back with checksum tests, with perceptual hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from islet.llm.batches import text_slices

#: Fixed values of the PNG format: its signature, and samples per pixel by colour type.
SIGNATURE, SAMPLES = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 4: 2, 6: 4}
CHUNK = 32 << 10


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _nearest(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of three neighbours the one nearest to left + up - corner; left before up before corner."""
    to_left, to_up = np.abs(up - corner), np.abs(left - corner)
    to_corner = np.abs(left + up - 2 * corner)
    return np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))


def filtered(pixels: np.ndarray, kind: int, step: int = 1) -> np.ndarray:
    """Rows of bytes under one of the format's five filters, with the filter's number before each."""
    left, up, corner = (np.zeros(pixels.shape, np.int16) for _ in range(3))
    left[:, step:], up[1:], corner[1:, step:] = pixels[:, :-step], pixels[:-1], pixels[:-1, :-step]
    guess = (0, left, up, (left + up) >> 1, None)[kind] if kind < 4 else _nearest(left, up, corner)
    out = np.empty((pixels.shape[0], pixels.shape[1] + 1), np.uint8)
    out[:, 0], out[:, 1:] = kind, pixels - guess
    return out


def unfiltered(rows: np.ndarray, step: int = 1) -> np.ndarray:
    """Rows of bytes from filtered rows. Runs of the first three filters are sums; others go by diagonals."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if (kinds > 4).any():
        raise ValueError("unknown filter")
    cuts = np.flatnonzero(np.diff(np.where(kinds > 2, 3, kinds))) + 1
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        run, above = out[a:b], out[a - 1] if a else np.zeros(out.shape[1], np.uint8)
        if kinds[a] == 1:
            cells = run.reshape(b - a, -1, step)
            np.cumsum(cells, axis=1, dtype=np.uint8, out=cells)
        elif kinds[a] == 2:
            run[0] += above
            np.cumsum(run, axis=0, dtype=np.uint8, out=run)
        elif kinds[a] > 2:
            _by_diagonals(run, kinds[a:b], above, step)
    return out


def _by_diagonals(run: np.ndarray, kinds: np.ndarray, above: np.ndarray, step: int) -> None:
    """A pixel needs those to its left and above, so all pixels of a diagonal can be done together."""
    high, wide = run.shape[0], run.shape[1] // step
    full = np.zeros((high + 1, wide + 1, step), np.int16)
    full[0, 1:], full[1:, 1:] = above.reshape(wide, step), run.reshape(high, wide, step)
    mean = (kinds == 3)[:, None]
    for d in range(high + wide - 1):
        i = np.arange(max(0, d - wide + 1), min(high, d + 1))
        j = d - i
        left, up, corner = full[i + 1, j], full[i, j + 1], full[i, j]
        guess = np.where(mean[i], (left + up) >> 1, _nearest(left, up, corner))
        full[i + 1, j + 1] = (full[i + 1, j + 1] + guess) & 255
    run[:] = full[1:, 1:].reshape(high, -1)


def encode(payload: bytes, width: int, filters: tuple[int, ...] = (0, 1, 2, 3, 4), level: int = 3) -> bytes:
    """A grey 8-bit image whose samples are the payload, of the filters the one that packs it best."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, width)
    packed = min((zlib.compress(filtered(pixels, k).tobytes(), level) for k in filters), key=len)
    head = struct.pack(">IIBBBBB", width, len(pixels), 8, 0, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def decode(image: bytes) -> np.ndarray:
    """Samples (height, width, samples) of a PNG; ValueError says what is wrong with it.

    Every chunk's checksum and the stream's own are tested. Read are 8-bit grey and colour images,
    with or without alpha, not interlaced.
    """
    if image[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, packed, kind = 8, None, [], b""
    while kind != b"IEND":
        if at + 12 > len(image):
            raise ValueError("cut off")
        size, kind = struct.unpack_from(">I4s", image, at)
        data = image[at + 8 : at + 8 + size]
        if len(data) < size or at + 12 + size > len(image):
            raise ValueError("cut off")
        if zlib.crc32(data, zlib.crc32(kind)) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError(f"checksum of {kind.decode('latin-1')}")
        if kind == b"IHDR":
            if size != 13:
                raise ValueError("bad header")
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            packed.append(data)
        elif kind != b"IEND" and not kind[0] & 32:
            raise ValueError("unsupported chunk")
        at += 12 + size
    if not head:
        raise ValueError("no header")
    wide, high, depth, colour, _, _, interlaced = head
    if depth != 8 or colour not in SAMPLES or interlaced:
        raise ValueError("unsupported image")
    step = SAMPLES[colour]
    inflate, size = zlib.decompressobj(), high * (1 + wide * step)
    try:
        raw = inflate.decompress(b"".join(packed), size + 1)
    except zlib.error as e:
        raise ValueError(f"zlib: {e}") from None
    if len(raw) != size or not inflate.eof:
        raise ValueError("wrong amount of samples")
    return unfiltered(np.frombuffer(raw, np.uint8).reshape(high, -1), step).reshape(high, wide, step)


def _shrunk(grey: np.ndarray, to: int) -> np.ndarray:
    """Mean of each of ``to`` equal bands of rows, with rows cut where a bound falls inside."""
    n = len(grey)
    bounds = np.arange(to + 1) * n
    whole, part = bounds // to, (bounds % to)[:, None] / to
    sums = np.concatenate([np.zeros((1, grey.shape[1])), np.cumsum(grey, axis=0, dtype=np.float64)])
    rows = np.concatenate([grey, np.zeros((1, grey.shape[1]), grey.dtype)])
    return np.diff(sums[whole] + part * rows[whole], axis=0) * (to / n)


_SIDE, _LOW = 32, 8
_COSINES = np.cos(np.pi * np.outer(np.arange(_LOW), np.arange(_SIDE) + 0.5) / _SIDE)


def perceptual_hash(samples: np.ndarray) -> bytes:
    """64 bits: the low-frequency cosine coefficients of the image at 32 by 32 against their median."""
    grey = samples[..., 0] if samples.shape[2] < 3 else samples[..., :3] @ np.array([0.299, 0.587, 0.114])
    if not grey.size:
        return bytes(8)
    small = _shrunk(_shrunk(grey, _SIDE).T, _SIDE).T
    low = np.round(_COSINES @ small @ _COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def _stored(width: int, unit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 8 << 20):
                texts = part.column(1).cast(pa.binary()).to_pylist()
                sizes = [len(t or b"") for t in texts]
                images = [encode((t or b"") + b"\xff" * (max(unit, -(-n // unit) * unit) - n), width) for t, n in zip(texts, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(images, pa.binary())], ["doc_id", "n_bytes", "media"])

    return run


def store(docs: DataFrame, width: int = 64, unit: int = 576) -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text's UTF-8 bytes, padded with 255 to a positive multiple of ``unit``, as a PNG.

    Null and empty texts are one unit of padding. Rows stand for themselves (null or repeated
    doc_ids, equal rows); other columns are not read; no rows give no rows.
    """
    if unit % width:
        raise ValueError("unit must be a multiple of width")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(_stored(width, unit), "doc_id long, n_bytes long, media binary")


def _read(pixels: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for image in part.column(2).to_pylist():
                    try:
                        if image is None:
                            raise ValueError("null")
                        samples = decode(image)
                    except ValueError as e:
                        rows.append((str(e), *[None] * 9))
                        continue
                    payload = samples.tobytes()
                    high, wide, step = samples.shape
                    rows.append(("ok", wide, high, step, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), hashlib.sha256(image).hexdigest(), perceptual_hash(samples), payload if pixels else None))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                sizes = pa.array([None if x is None else len(x) for x in part.column(2).to_pylist()], pa.int64())
                names = ["doc_id", "n_bytes", "media_bytes", "status", "width", "height", "samples", "payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "phash", "pixels"]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sizes, *columns], names)

    return run


def read(media: DataFrame, pixels: bool = False) -> DataFrame:
    """Each image of ``doc_id, n_bytes, media`` read back.

    ``status`` is ``ok`` or what is wrong (null, cut off, a checksum, unsupported ...); then all
    that follows is null: width, height, samples a pixel, payload_bytes, payload_sha256, tail_crc32
    (last 32 bytes), media_sha256, ``phash`` (8 bytes) and, if asked for, ``pixels``.
    """
    schema = "doc_id long, n_bytes long, media_bytes long, status string, width int, height int, samples int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, phash binary, pixels binary"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read(pixels), schema)
