"""FLAC: exact round trips, features against plain sums, and streams written bit by bit."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import flac

from .fixtures import DOCS, clashing, corpus, empty


class Writer:
    """A FLAC stream of one channel by plain bit strings."""

    def __init__(self, samples, depth=8, block=256):
        self.samples, self.depth, self.block, self.frames = samples, depth, block, []

    def bits(self, value, width):
        return format(value & ((1 << width) - 1), f"0{width}b") if width else ""

    def rice(self, v, k):
        u = 2 * v if v >= 0 else -2 * v - 1
        return "0" * (u >> k) + "1" + self.bits(u, k)

    def frame(self, number, kind, order=0, coefficients=(), shift=0, parts=0, k=3, escape=False, wide=False):
        s = self.samples[number * self.block : (number + 1) * self.block]
        d = self.depth
        head = flac._frame_head(len(s), number)
        head = head[:3] + bytes(({8: 1, 12: 2, 16: 4}[d] << 1,)) + head[4:-1]
        head += bytes((flac.crc8(head),))
        if kind == "constant":
            body = "00000000" + self.bits(s[0], d)
        elif kind == "verbatim":
            body = "00000010" + "".join(self.bits(x, d) for x in s)
        else:
            fixed = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
            taps, sh = (fixed[order], 0) if kind == "fixed" else (list(coefficients), shift)
            order = len(taps)
            body = "0" + self.bits(8 + order if kind == "fixed" else 32 + order - 1, 6) + "0" + "".join(self.bits(x, d) for x in s[:order])
            if kind == "lpc":
                body += self.bits(9, 4) + self.bits(sh, 5) + "".join(self.bits(c, 10) for c in taps)
            body += ("01" if wide else "00") + self.bits(parts, 4)
            r = [s[i] - (sum(c * s[i - 1 - j] for j, c in enumerate(taps)) >> sh) for i in range(order, len(s))]
            size, at = len(s) >> parts, 0
            for p in range(1 << parts):
                n = size - (order if p == 0 else 0)
                if escape and p % 2 == 0:
                    body += self.bits(31 if wide else 15, 5 if wide else 4) + self.bits(18, 5) + "".join(self.bits(x, 18) for x in r[at : at + n])
                else:
                    body += self.bits(k + p % 2, 5 if wide else 4) + "".join(self.rice(x, k + p % 2) for x in r[at : at + n])
                at += n
        body += "0" * (-len(body) % 8)
        data = head + int(body, 2).to_bytes(len(body) // 8, "big")
        x = 0
        for b in data:
            x = (x << 8 & 0xFFFF) ^ flac._CRC16[x >> 8 ^ b]
        self.frames.append(data + struct.pack(">H", x))

    def stream(self):
        raw = np.array(self.samples).astype("<i1" if self.depth == 8 else "<i2").tobytes()
        info = struct.pack(">HH6s", self.block, self.block, b"") + struct.pack(">Q", 8000 << 44 | (self.depth - 1) << 36 | len(self.samples)) + hashlib.md5(raw).digest()
        return b"fLaC" + struct.pack(">I", 0x80000000 | 34) + info + b"".join(self.frames)


@pytest.mark.parametrize("depth", [8, 16])
def test_all_subframes(depth):
    rng = np.random.default_rng(depth)
    top = 1 << (depth - 1)
    wave = (0.6 * top * np.sin(np.arange(256 * 9) / 9) + rng.integers(-9, 9, 256 * 9)).astype(int).clip(-top, top - 1)
    wave[:256] = 5
    w = Writer(wave.tolist(), depth)
    w.frame(0, "constant")
    w.frame(1, "verbatim")
    for n, order in enumerate((0, 1, 2, 3, 4), 2):
        w.frame(n, "fixed", order=order, parts=order % 3, k=depth - 5, escape=order == 3, wide=order == 4)
    w.frame(7, "lpc", coefficients=[250, -120, 3], shift=7, parts=2, k=depth - 4)
    w.frame(8, "lpc", coefficients=[120], shift=7, parts=3, k=0, escape=True)
    (samples, offsets, info), = flac.decode([w.stream()])
    assert samples.tolist() == wave.tolist() and offsets.tolist() == [256 * k for k in range(9)] and info["rate"] == 8000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=3000) | st.integers(1, 3000).map(lambda n: b"\xff\xf8" * n) | st.integers(1, 3000).map(lambda n: b"a" * n), max_size=5))
def test_round_trip(texts):
    payloads = [flac.padded(t) for t in texts]
    assert [(x + 128).astype(np.uint8).tobytes() for x, _, _ in flac.decode(flac.encode(payloads))] == payloads


def test_linear_predictors_are_written_and_read():
    rng = np.random.default_rng(1)
    wave = np.clip(128 + 60 * np.sin(np.arange(4992) / 9) + rng.normal(0, 3, 4992), 0, 255).astype(np.uint8).tobytes()
    payloads = [wave, flac.padded(b"plain words " * 400), bytes(64), wave[:64]]
    streams = flac.encode(payloads)
    assert [(x + 128).astype(np.uint8).tobytes() for x, _, _ in flac.decode(streams)] == payloads
    kinds = [{d[f[0] + f[2]] >> 1 for f in flac._frames(d)[1]} for d in streams]
    assert kinds[0] == {31 + flac.LINEAR} and kinds[2] == {0} and len(streams[0]) < 0.7 * len(wave)


def plain_feature(payload):
    x = [b - 128 for b in payload]
    steps = [abs(b - a) for a, b in zip(x, x[1:])]
    return f"peak={max(map(abs, x))};energy={sum(v * v for v in x)};crossings={sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))};step={sum(steps)}"


def test_features_clashing_names_and_depths(spark):
    df = clashing(spark).select("*", F.lit("mine").alias("media_bytes"), flac.text_to_flac(F.col("text")).alias("media"), F.lit("mine").alias("pcm"))
    for r in df.select("text", "media_bytes", flac.media_features(F.col("media")).alias("f")).collect():
        payload = flac.padded((r["text"] or "").encode())
        assert r["f"]["feature"] == plain_feature(payload) and r["media_bytes"] == "mine"
        assert (r["f"]["frames"], r["f"]["pcm_blocks"]) == (-(-len(payload) // flac.BLOCK), -(-len(payload) // flac.PCM_SAMPLES))
    assert flac.pcm_blocks(df, "doc_id", "media").count() == df.count() + sum(-(-len(flac.padded((t or "").encode())) // flac.PCM_SAMPLES) - 1 for _, t, *_ in DOCS)
    deep = bytearray(flac.encode([bytes(64)])[0])
    deep[20:22] = struct.pack(">H", int.from_bytes(deep[20:22], "big") & 0xFE0F | 15 << 4)
    bad = spark.createDataFrame([(bytes(deep),)], "media binary").select(flac.media_features(F.col("media")))
    with pytest.raises(Exception, match="bits a sample|MD5|crc"):
        bad.collect()


def test_damage_is_found():
    stream, = flac.encode([flac.padded(b"some text " * 500)])
    for at in (len(stream) - 1, len(stream) - 900, 30):
        broken = bytearray(stream)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])


def test_padding():
    assert [len(flac.padded(b"x" * n)) for n in (0, 1, 64, 65)] == [64, 64, 64, 128]


def test_columns(spark):
    df = corpus(spark)
    text = F.coalesce("text", F.lit(""))
    stored = df.select("doc_id", "text", flac.text_to_flac(text).alias("media"))
    got = stored.select("text", "media", flac.media_features(F.col("media")).alias("f")).collect()
    assert len(got) == len(DOCS)
    for r in got:
        payload = flac.padded((r["text"] or "").encode())
        assert (r["f"]["payload_bytes"], r["f"]["payload_sha256"], r["f"]["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["f"]["media_bytes"], r["f"]["media_sha256"]) == (len(r["media"]), hashlib.sha256(r["media"]).hexdigest())
    blocks = flac.pcm_blocks(stored, "doc_id", "media", samples=4096).where("doc_id = 9").orderBy("block").collect()
    raw = b"".join(r["pcm"] for r in blocks)
    assert bytes(b ^ 128 for b in raw) == flac.padded(DOCS[11][1].encode()) and [r["sample_offset"] for r in blocks] == [4096 * k for k in range(len(blocks))]
    none = empty(spark).select("doc_id", flac.text_to_flac(F.col("text")).alias("media"))
    assert none.select(flac.media_features(F.col("media"))).count() == 0 and flac.pcm_blocks(none, "doc_id", "media").count() == 0
