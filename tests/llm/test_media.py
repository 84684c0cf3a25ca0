import hashlib
import math
import struct
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from islet.llm import media
from islet.llm.queries import op1_media

from .samples import ODD, none, odd


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 12), st.sampled_from([1, 2, 3, 4]), st.randoms(use_true_random=False))
def test_any_mix_of_filters_is_undone(high, wide, step, rng):
    pixels = np.array([[rng.randrange(256) for _ in range(wide * step)] for _ in range(high)], np.uint8)
    kinds = [rng.randrange(5) for _ in range(high)]
    rows = np.stack([media.filtered(pixels, k, step)[i] for i, k in enumerate(kinds)])
    assert np.array_equal(media.unfiltered(rows, step), pixels)


def test_undoing_agrees_with_a_byte_by_byte_decoder():
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 256, (40, 25), np.uint8)
    rows[:, 0] = rng.integers(0, 5, 40)
    out = np.zeros((40, 24), int)
    for i in range(40):
        for j in range(24):
            a = out[i, j - 3] if j >= 3 else 0
            b = out[i - 1, j] if i else 0
            c = out[i - 1, j - 3] if i and j >= 3 else 0
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out[i, j] = (int(rows[i, j + 1]) + (0, a, b, (a + b) // 2, nearest)[rows[i, 0]]) % 256
    assert np.array_equal(media.unfiltered(rows, 3), out)


def test_broken_images_are_told():
    good = media.encode(bytes(range(256)) * 9, 64)
    assert media.decode(good).tobytes() == bytes(range(256)) * 9
    for bad, why in ((good[:-4], "cut off"), (b"x" + good[1:], "signature"), (good[:60] + bytes([good[60] ^ 1]) + good[61:], "checksum"), (b"", "signature")):
        with pytest.raises(ValueError, match=why):
            media.decode(bad)
    head = struct.pack(">IIBBBBB", 4, 4, 8, 0, 0, 0, 0)
    short = media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", zlib.compress(b"\0" * 7)) + media._chunk(b"IEND", b"")
    with pytest.raises(ValueError, match="amount"):
        media.decode(short)


def test_query_against_brute_force(spark):
    rows = op1_media(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    by_text = {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["status"]) == (len(raw), len(payload), "ok")
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert by_text.setdefault(raw, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def test_hash_survives_small_changes():
    rng = np.random.default_rng(1)
    image = np.kron(rng.integers(0, 256, (8, 8)), np.ones((12, 8)))
    a = media.perceptual_hash(image.astype(np.uint8)[..., None])
    b = media.perceptual_hash(np.clip(image + rng.normal(0, 2, image.shape), 0, 255).astype(np.uint8)[..., None])
    c = media.perceptual_hash(rng.integers(0, 256, (96, 64, 1), np.uint8))
    apart = lambda x, y: bin(int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).count("1")
    assert apart(a, b) <= 8 < 16 <= apart(a, c)


def test_odd_rows(spark):
    stored = media.store(odd(spark))
    rows = media.read(stored).collect()
    assert len(rows) == len(ODD) and all(r["status"] == "ok" for r in rows)
    assert all(r["payload_bytes"] == 576 and r["n_bytes"] == 0 for r in rows if r["doc_id"] in (1, 2))
    assert media.read(media.store(none(spark))).count() == 0
    broken = spark.createDataFrame([(1, 0, None), (2, 0, bytearray(b"abc"))], "doc_id long, n_bytes long, media binary")
    assert {r["doc_id"]: r["status"] for r in media.read(broken).collect()} == {1: "null", 2: "no PNG signature"}


def plain_hash(samples):
    """The hash by its definition: means over 32 x 32 equal cells, cosine sums, bits above the median of all but the first."""
    high, wide = samples.shape

    def shrink(rows):
        n, out = len(rows), []
        for k in range(32):
            a, b = Fraction(k * n, 32), Fraction((k + 1) * n, 32)
            parts = [(min(b, i + 1) - max(a, i), rows[i]) for i in range(math.floor(a), math.ceil(b))]
            out.append([float(sum(w * Fraction(r[j]) for w, r in parts) / (b - a)) for j in range(len(rows[0]))])
        return out

    small = list(zip(*shrink([list(c) for c in zip(*shrink(samples.tolist()))])))
    low = []
    for u in range(8):
        for v in range(8):
            low.append(round(sum(small[i][j] * math.cos(math.pi * u * (i + 0.5) / 32) * math.cos(math.pi * v * (j + 0.5) / 32) for i in range(32) for j in range(32)), 6))
    middle = sorted(low[1:])[31]
    return sum((x > middle) << (63 - k) for k, x in enumerate(low)).to_bytes(8, "big")


def test_feature_of_the_query_by_its_definition(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in op1_media(spark, "/root/testdata/sf0.001").collect()}
    for doc in sorted(texts, key=lambda d: len(texts[d] or ""))[::40]:
        raw = (texts[doc] or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        image = media.encode(payload, 64)
        assert rows[doc]["media_sha256"] == hashlib.sha256(image).hexdigest() and rows[doc]["media_bytes"] == len(image)
        assert rows[doc]["feature"] == plain_hash(np.frombuffer(payload, np.uint8).reshape(-1, 64)).hex()


def test_very_long_texts(spark):
    text = "a very long text " * 60_000
    row = media.read(media.store(spark.createDataFrame([(1, text)], "doc_id long, text string")), pixels=True).first()
    assert row["status"] == "ok" and row["pixels"][: row["n_bytes"]] == text.encode()
