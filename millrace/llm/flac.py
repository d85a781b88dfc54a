"""FLAC media columns: a decoder for Rice residuals and linear predictors, with an encoder to feed it.

One channel of at most 16 bits a sample. Work is laid out in lanes: all frames of a batch of streams
are decoded in step, sample by sample, so the inner loops are array operations over thousands of frames.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import byte_batches

BLOCK = 1024
RATE = 8000
#: A batch is held in some 25 arrays of 8 bytes a sample.
BATCH_BYTES = 1 << 20
SEEK_FRAMES = 16
#: The encoder's linear predictors: coefficients, bits of each, and the bits that tell of them in a frame.
LINEAR, PRECISION = 4, 8
HEAD = 9 + LINEAR * PRECISION
#: How a table of media is written: headers and repeated frames shrink by zstd over large pages.
STORED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(8 << 20)}
#: Samples of a PCM block.
PCM_SAMPLES = 1 << 16
#: Block sizes by their code in a frame header (fixed values of the format).
SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
#: Bits a sample by their code (fixed values of the format); 0 refers to the stream's header.
DEPTHS = {1: 8, 2: 12, 4: 16}
_SYNC = re.compile(b"\xff[\xf8\xf9]")
_LEADING = np.array([16 - int(x).bit_length() for x in range(1 << 16)], np.int64)


def _crc_table(poly: int, bits: int) -> list[int]:
    out = []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1) ^ (poly if x >> (bits - 1) & 1 else 0)
        out.append(x & ((1 << bits) - 1))
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    x = 0
    for b in data:
        x = _CRC8[x ^ b]
    return x


@functools.lru_cache(maxsize=4)
def _crc16_by_place(most: int) -> np.ndarray:
    """What a byte adds to the crc16 when so many bytes follow it."""
    step = np.array(_CRC16, np.uint16)
    out = np.empty((most, 256), np.uint16)
    out[0] = step
    for d in range(1, most):
        out[d] = (out[d - 1] << np.uint16(8)) ^ step[out[d - 1] >> np.uint16(8)]
    return out


def crc16s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc16 of each range of data; a crc is linear, so it is an exclusive or over the bytes."""
    size = ends - starts
    out = np.zeros(len(size), np.uint16)
    span = 1 << 14
    table = _crc16_by_place(min(span, 1 << max(4, int(size.max() - 1).bit_length())) if len(size) else 16)
    short = np.flatnonzero((size <= len(table)) & (size > 0))
    step = 4096
    for at in range(0, len(short), step):
        some = short[at : at + step]
        n = size[some]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        bytes_ = data[np.repeat(starts[some], n) + place]
        out[some] = np.bitwise_xor.reduceat(table[np.repeat(n, n) - 1 - place, bytes_], first)
    for k in np.flatnonzero(size > len(table)):
        x = 0
        for b in data[starts[k] : ends[k]].tobytes():
            x = (x << 8 & 0xFFFF) ^ _CRC16[x >> 8 ^ b]
        out[k] = x
    return out


def _coded_number(n: int) -> bytes:
    if n < 0x80:
        return bytes((n,))
    rest = []
    while n >= 1 << (6 - len(rest)):
        rest.append(0x80 | n & 63)
        n >>= 6
    return bytes(((0xFF << (7 - len(rest)) & 0xFF) | n, *reversed(rest)))


@functools.lru_cache(maxsize=1 << 14)
def _frame_head(size: int, number: int) -> bytes:
    code = next((c for c, s in SIZES.items() if s == size), 7)
    head = bytes((0xFF, 0xF8, code << 4 | 4, 1 << 1)) + _coded_number(number) + (struct.pack(">H", size - 1) if code == 7 else b"")
    return head + bytes((crc8(head),))


def linear_predictors(x: np.ndarray, first: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (LINEAR, frames) of PRECISION bits and their shifts, by autocorrelation of each frame."""
    r = [np.add.reduceat(x * x, first).astype(float)]
    for lag in range(1, LINEAR + 1):
        both = np.zeros(len(x), np.int64)
        both[lag:] = x[lag:] * x[:-lag]
        both[place < lag] = 0
        r.append(np.add.reduceat(both, first).astype(float))
    error = r[0] + 1.0
    a = np.zeros((LINEAR, len(first)))
    for i in range(LINEAR):
        k = (r[i + 1] - sum(a[j] * r[i - j] for j in range(i))) / error
        before = a[:i].copy()
        a[i] = k
        a[:i] = before - k * before[::-1]
        error = np.maximum(error * (1 - k * k), 1e-9)
    limit = (1 << PRECISION - 1) - 1
    shift = np.clip(np.floor(np.log2(limit / np.maximum(np.abs(a).max(0), 1e-9))), 0, 14).astype(np.int64)
    return np.clip(np.rint(a * 2.0**shift), -limit - 1, limit).astype(np.int64), shift


def encode(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """A FLAC stream of each payload, whose bytes are samples of 8 bits (less 128).

    Payloads have 16 bytes or more, and no last frame of under 16. Each frame takes the best of
    fixed predictors of order 0 to 2 and a linear one of order LINEAR, with one Rice parameter, a
    constant or the plain samples.
    """
    if not payloads:
        return []
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    x = raw.astype(np.int64) - 128
    sizes = np.array([len(p) for p in payloads])
    frames = -(-sizes // block)
    owner = np.repeat(np.arange(len(payloads)), frames)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(frames) - frames, frames)
    n = np.minimum(block, sizes[owner] - number * block)
    first = np.cumsum(n) - n
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(x)) - first[of]

    residuals = [x]
    for order in (1, 2):
        d = residuals[-1].copy()
        d[1:] -= residuals[-1][:-1]
        d[place < order] = 0
        residuals.append(d)
    costs = np.stack([np.add.reduceat(np.abs(r), first) for r in residuals])
    order = costs.argmin(0)
    constant = np.add.reduceat(np.abs(residuals[1]), first) == 0
    order[constant] = 0
    # A linear predictor costs its coefficients, so it has to be that much better.
    weights, shift = linear_predictors(x, first, place)
    guess = np.zeros(len(x), np.int64)
    for j in range(LINEAR):
        guess[j + 1 :] += weights[j][of[j + 1 :]] * x[: -j - 1]
    guess = x - (guess >> shift[of])
    guess[place < LINEAR] = 0
    linear = ~constant & (n >= 64) & (np.add.reduceat(np.abs(guess), first) < 0.95 * costs.min(0))
    order[linear] = 3
    r = np.choose(order[of], [*residuals, guess])
    order[linear] = LINEAR
    u = (r << 1) ^ (r >> 63)
    mean = np.add.reduceat(np.where(place >= order[of], u, 0), first) / np.maximum(1, n - order)
    k = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))), 0, 14).astype(np.int64)
    kk = k[of]
    q = u >> kk
    length = q + 1 + kk
    warm = place < order[of]
    length[warm] = 8
    plain = np.add.reduceat(length, first) + 10 >= 8 * n
    plain &= ~constant
    linear &= ~plain
    order[plain] = 0
    flat = (plain | constant)[of]
    width = np.where(warm | flat, 8, kk + 1)
    value = np.where(warm | flat, x & 255, (1 << kk) | (u & ((1 << kk) - 1)))
    length[flat] = 8
    cut = constant[of] & (place > 0)
    length[cut] = width[cut] = value[cut] = 0
    rice = ~(plain | constant)
    length[(first + order)[rice]] += 10
    length[(first + order)[linear]] += HEAD

    heads = [_frame_head(a, b) for a, b in zip(n.tolist(), number.tolist())]
    head = np.array([len(h) for h in heads])
    bits = np.add.reduceat(length, first)
    total = head + (8 + bits + 7) // 8 + 2
    points = -(-frames // SEEK_FRAMES)
    lead = np.zeros(len(n), np.int64)
    lead[np.cumsum(frames) - frames] = 42 + 4 + 18 * points
    start = np.cumsum(total + lead) - total
    whole = int(start[-1] + total[-1])

    base = (start + head) * 8
    done = np.cumsum(length)
    end = done - np.repeat(done[first] - length[first], n) + base[of] + 8
    kinds = np.where(constant, 0, np.where(plain, 1, np.where(linear, 31 + LINEAR, 8 + order))) << 1
    open_ = end - length  # where a sample's bits begin, and at the first residual what tells of the predictor
    told = open_[(first + order)[linear]]
    at = [end - width, base, open_[(first + order)[rice]] + HEAD * linear[rice], told]
    wide = [width, np.full(len(n), 8), np.full(int(rice.sum()), 10), np.full(len(told), 9)]
    what = [value, kinds, k[rice], PRECISION - 1 << 5 | shift[linear]]
    for j in range(LINEAR):
        at.append(told + 9 + PRECISION * j)
        wide.append(np.full(len(told), PRECISION))
        what.append(weights[j][linear] & (1 << PRECISION) - 1)
    at, wide, what = np.concatenate(at), np.concatenate(wide), np.concatenate(what)
    word, up = at >> 5, 64 - (at & 31) - wide
    window = what.astype(np.uint64) << np.where(wide > 0, up, 0).astype(np.uint64)
    words = np.bincount(word, (window >> np.uint64(32)).astype(float), whole // 4 + 3)
    words[1:] += np.bincount(word, (window & np.uint64(0xFFFFFFFF)).astype(float), whole // 4 + 3)[:-1]
    out = words.astype(np.uint32).astype(">u4").view(np.uint8)[: whole].copy()

    joined = np.frombuffer(b"".join(heads), np.uint8)
    inner = np.arange(len(joined)) - np.repeat(np.cumsum(head) - head, head)
    out[np.repeat(start, head) + inner] = joined
    crc = crc16s(out, start, start + total - 2)
    out[start + total - 2], out[start + total - 1] = crc >> 8, crc & 255
    edges = np.cumsum(frames)
    result = []
    for d, (payload, a, b) in enumerate(zip(payloads, edges - frames, edges)):
        seeks = b"".join(struct.pack(">QQH", j * block, start[a + j] - start[a], n[a + j]) for j in range(0, b - a, SEEK_FRAMES))
        info = struct.pack(">HH3s3s", block, block, b"\0\0\0", b"\0\0\0") + struct.pack(">Q", RATE << 44 | 7 << 36 | len(payload))
        info += hashlib.md5(payload.translate(_SIGNED)).digest()
        lead_bytes = b"fLaC" + struct.pack(">I", 34) + info + struct.pack(">I", 0x83000000 | len(seeks)) + seeks
        result.append(lead_bytes + out[start[a] : start[b - 1] + total[b - 1]].tobytes())
    return result


_SIGNED = bytes(b ^ 128 for b in range(256))


def _parse_head(data: bytes, at: int, depth: int) -> tuple[int, int, int, int] | None:
    """(number, samples, bits a sample, bytes) of the frame header at a place, if it is one whose crc8 holds."""
    if len(data) < at + 6:
        return None
    size_code, rate_code, channels, depth_code = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    if channels or size_code == 0 or rate_code == 15 or data[at + 3] & 1 or depth_code in (3, 5, 6, 7):
        return None
    lead = data[at + 4]
    more = 0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()
    if lead >= 0x80 and not 1 <= more <= 6:
        return None
    number = lead & (0x7F >> (more + 1 if more else 0))
    p = at + 5 + more
    for b in data[at + 5 : p]:
        number = number << 6 | b & 63
    extra = 1 if size_code == 6 else 2 if size_code == 7 else 0
    samples = int.from_bytes(data[p : p + extra], "big") + 1 if extra else SIZES[size_code]
    p += extra + {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if p >= len(data) or crc8(data[at:p]) != data[p]:
        return None
    return number, samples, DEPTHS.get(depth_code, depth), p + 1 - at


def _frames(data: bytes) -> tuple[dict, list[tuple[int, int, int, int, int]]]:
    """The stream's header and its frames as (start, end, head bytes, samples, bits a sample).

    A frame ends where the next header with the next number begins; decode() checks every crc16.
    """
    if data[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, info = 4, None
    while True:
        kind, n = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        if kind & 127 == 0:
            packed = int.from_bytes(data[at + 14 : at + 22], "big")
            info = {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "depth": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": data[at + 22 : at + 38]}
        at += 4 + n
        if kind & 128:
            break
    if info is None or info["channels"] != 1 or info["depth"] > 16:
        raise ValueError("not one channel of at most 16 bits")
    found = []
    variable = None
    wanted = samples = 0
    for m in _SYNC.finditer(data, at):
        s = m.start()
        head = _parse_head(data, s, info["depth"])
        if head and (variable is None or variable == (data[s + 1] & 1)):
            if head[0] == (samples if data[s + 1] & 1 else wanted):
                variable = data[s + 1] & 1
                found.append((s, head))
                wanted += 1
                samples += head[1]
    if not found and info["samples"] or found and found[0][0] != at:
        raise ValueError("no frame where the first should be")
    edges = [s for s, _ in found[1:]] + [len(data)]
    return info, [(s, e, h[3], h[1], h[2]) for (s, h), e in zip(found, edges)]


class _Bits:
    """Places in a byte string, one a lane, read in step."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
        self.words = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
        self.at = at.astype(np.int64)

    def read(self, lanes: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Up to 25 bits of each of some lanes, unsigned."""
        p = self.at[lanes]
        w = self.words[p >> 3].astype(np.int64)
        self.at[lanes] = p + width
        return w >> (32 - (p & 7) - width) & ((1 << np.asarray(width, np.int64)) - 1)

    def rice(self, count: int, k: np.ndarray) -> np.ndarray:
        """One Rice code of each of the first count lanes, zigzag undone."""
        p = self.at[:count]
        x = self.words[p >> 3].astype(np.int64) << (p & 7) & 0xFFFFFFFF
        q = _LEADING[x >> 16]
        used = q + 1 + k
        u = q << k | (x >> (31 - q - k).clip(0)) & ((1 << k) - 1)
        hard = np.flatnonzero((q > 15) | (used > 25))
        if len(hard):
            start, q2 = p[hard].copy(), np.zeros(len(hard), np.int64)
            open_ = np.arange(len(hard))
            while len(open_):
                at = start[open_] + q2[open_]
                y = self.words[at >> 3].astype(np.int64) << (at & 7) & 0xFFFFFFFF
                z = _LEADING[y >> 16]
                q2[open_] += z
                open_ = open_[z > 15]
                if len(open_) and q2.max() > 1 << 24:
                    raise ValueError("a Rice code without end")
            self.at[hard] = start + q2 + 1
            low = self.read(hard, k[hard])
            u[hard] = q2 << k[hard] | low
            used[hard] = q2 + 1 + k[hard]
            self.at[hard] = start
        self.at[:count] += used
        return u >> 1 ^ -(u & 1)


def _signed(v: np.ndarray, width) -> np.ndarray:
    return v - ((v >> (np.asarray(width) - 1) & 1) << width)


def _samples(data: np.ndarray, start: np.ndarray, n: np.ndarray, depth: np.ndarray) -> list[np.ndarray]:
    """The samples of each frame, whose subframe begins at byte start and has n samples of depth bits."""
    order_of = np.argsort(-n, kind="stable")
    start, n, depth = start[order_of], n[order_of], depth[order_of]
    lanes = np.arange(len(n))
    bits = _Bits(data, start * 8)
    kind = bits.read(lanes, 8)
    wasted = np.zeros(len(n), np.int64)
    for lane in np.flatnonzero(kind & 1):
        while bits.read(lanes[lane : lane + 1], 1)[0] == 0:
            wasted[lane] += 1
        wasted[lane] += 1
    depth = depth - wasted
    kind = kind >> 1
    linear, fixed = kind >= 32, (kind >= 8) & (kind <= 12)
    if (~(linear | fixed | (kind < 2))).any():
        raise ValueError("unknown subframe")
    order = np.where(linear, kind - 31, np.where(fixed, kind - 8, 0))
    s = np.zeros((int(n[0]), len(n)), np.int64)
    for i in range(int(n.max())):
        live = lanes[(i < n) & ((kind == 1) | (i < order) | ((kind == 0) & (i == 0)))] if i < 32 or (kind == 1).any() else lanes[:0]
        if not len(live):
            if i >= 32:
                break
            continue
        s[i, live] = _signed(bits.read(live, depth[live]), depth[live])
    for lane in np.flatnonzero(kind == 0):
        s[: n[lane], lane] = s[0, lane]
    coefficients, shift = np.zeros((32, len(n)), np.int64), np.zeros(len(n), np.int64)
    if linear.any():
        own = lanes[linear]
        precision = bits.read(own, 4) + 1
        shift[own] = bits.read(own, 5)
        for j in range(int(order[own].max())):
            some = order[own] > j
            coefficients[j, own[some]] = _signed(bits.read(own[some], precision[some]), precision[some])
    coded = np.flatnonzero(linear | fixed)
    if len(coded):
        method = bits.read(coded, 2)
        if (method > 1).any():
            raise ValueError("unknown residual coding")
        parts = bits.read(coded, 4)
        part = n[coded] >> parts
        place = order[coded].copy()  # the sample that comes next in each lane
        border = np.where(parts == 0, n[coded], part)
        stop = n[coded]
        sub = _Bits.__new__(_Bits)
        sub.words, sub.at = bits.words, bits.at[coded]
        k, raw = np.zeros(len(coded), np.int64), np.full(len(coded), -1)
        need = np.ones(len(coded), bool)
        rank = np.argsort(-(stop - place), kind="stable")
        coded, method, part, place, border, stop = (v[rank] for v in (coded, method, part, place, border, stop))
        sub.at = sub.at[rank]
        left = stop - place
        for i in range(int(left[0])):
            count = int(np.searchsorted(-left, -i))
            if need[:count].any():
                some = np.flatnonzero(need[:count])
                wide = method[some] + 4
                k[some] = sub.read(some, wide)
                escaped = k[some] == (1 << wide) - 1
                raw[some] = -1
                if escaped.any():
                    raw[some[escaped]] = sub.read(some[escaped], 5)
                    k[some[escaped]] = 0
            if (raw[:count] >= 0).any():
                value = np.zeros(count, np.int64)
                plain = np.flatnonzero(raw[:count] >= 0)
                wide = raw[plain]
                got = np.where(wide > 0, _signed(sub.read(plain, wide), np.maximum(wide, 1)), 0)
                before = sub.at[plain].copy()
                value = sub.rice(count, k[:count])
                sub.at[plain] = before
                value[plain] = got
            else:
                value = sub.rice(count, k[:count])
            s[place[:count], coded[:count]] = value
            place[:count] += 1
            need[:count] = (place[:count] == border[:count]) & (place[:count] < stop[:count])
            if need[:count].any():
                border[:count][need[:count]] += part[:count][need[:count]]
    for p in range(1, 5):
        own = np.flatnonzero(fixed & (order == p))
        if len(own):
            t = s[:, own]
            starts = [t[:p]]
            for _ in range(p):
                starts.append(np.diff(starts[-1], axis=0))
            level = t[p:]
            for j in range(p - 1, -1, -1):
                level = np.cumsum(np.concatenate([starts[j][p - 1 - j : p - j] if j else t[p - 1 : p], level]), axis=0)[1:]
            s[p:, own] = level
    if linear.any():
        own = np.flatnonzero(linear)
        for i in range(1, int(n[own].max())):
            some = own[(i >= order[own]) & (i < n[own])]
            back = np.zeros(len(some), np.int64)
            for j in range(min(i, int(order[own].max()))):
                back += coefficients[j, some] * s[i - 1 - j, some]
            s[i, some] += back >> shift[some]
    s <<= wasted
    out: list = [None] * len(n)
    columns = np.ascontiguousarray(s.T)
    for lane, k in enumerate(order_of.tolist()):
        out[k] = columns[lane, : n[lane]]
    return out


def decode(streams: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, dict]]:
    """(samples, first sample of each frame, stream header) of each stream.

    crc8 of every frame header, crc16 of every frame, the number of samples and the MD5 of the
    samples are verified; ValueError says what does not hold.
    """
    heads = [_frames(data) for data in streams]
    base = np.cumsum([0, *map(len, streams)])
    joined = np.frombuffer(b"".join(streams), np.uint8)
    lines = np.array([(base[k] + f[0], base[k] + f[1], *f[2:]) for k, (_, frames) in enumerate(heads) for f in frames], np.int64).reshape(-1, 5)
    counts = [len(frames) for _, frames in heads]
    if len(lines):
        want = joined[lines[:, 1] - 2].astype(int) << 8 | joined[lines[:, 1] - 1]
        if (crc16s(joined, lines[:, 0], lines[:, 1] - 2) != want).any():
            # A sync pattern inside a frame can pass for a header: join such pieces, then judge.
            lines, counts = _joined_pieces(joined, lines, counts)
        found = _samples(joined, lines[:, 0] + lines[:, 2], lines[:, 3], lines[:, 4])
    else:
        found = []
    out, at = [], 0
    for (info, _), count in zip(heads, counts):
        own = found[at : at + count]
        samples = np.concatenate(own) if own else np.zeros(0, np.int64)
        if info["samples"] and len(samples) != info["samples"]:
            raise ValueError("samples are missing")
        width = (info["depth"] + 7) // 8
        if any(info["md5"]) and hashlib.md5(samples.astype(f"<i{width}").tobytes()).digest() != info["md5"]:
            raise ValueError("the samples' MD5 does not hold")
        offsets = np.cumsum([0, *lines[at : at + count, 3]])[:-1]
        out.append((samples, offsets, info))
        at += count
    return out


def _joined_pieces(data: np.ndarray, lines: np.ndarray, counts: list[int]) -> tuple[np.ndarray, list[int]]:
    new, kept, at = [], [], 0
    for count in counts:
        own, k, before = lines[at : at + count], 0, len(new)
        while k < count:
            for e in range(k, count):
                s, end = own[k, 0], own[e, 1]
                if int(crc16s(data, np.array([s]), np.array([end - 2]))[0]) == int(data[end - 2]) << 8 | int(data[end - 1]):
                    new.append([s, end, *own[k, 2:]])
                    k = e + 1
                    break
            else:
                raise ValueError("a frame's crc16 does not hold")
        kept.append(len(new) - before)
        at += count
    return np.array(new, np.int64), kept


def padded(text: bytes, unit: int = 64) -> bytes:
    return text + b"\0" * (unit - len(text) % unit if len(text) % unit or not text else 0)


def _sizes(column: pa.Array) -> list[int]:
    return [len(x.as_buffer()) if x.is_valid else 0 for x in column.cast(pa.large_binary())]


@F.arrow_udf(BinaryType())
def text_to_flac(column: pa.Array) -> pa.Array:
    """UTF-8 of each whole text (null: empty), zero bytes up to a positive multiple of 64, as FLAC. Equal texts give equal streams."""
    out: list[bytes] = []
    for a, b in byte_batches(_sizes(column), BATCH_BYTES):
        out += encode([padded(x or b"") for x in column.slice(a, b - a).cast(pa.large_binary()).to_pylist()])
    return pa.array(out, pa.binary())


FEATURES = "struct<pcm_blocks bigint, frames bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string>"


def feature(samples: np.ndarray) -> str:
    """Peak, energy, sign changes and the mean absolute step, from integer sums."""
    x = samples.astype(np.int64)
    steps = np.abs(np.diff(x))
    return f"peak={int(np.abs(x).max(initial=0))};energy={int((x * x).sum())};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};step={int(steps.sum())}"


def pcm_pieces(samples: np.ndarray, depth: int, size: int = PCM_SAMPLES) -> list[tuple[int, int, bytes]]:
    """(sample offset, samples, PCM) of each block of size samples, signed little-endian; the block of a sample is its number by size."""
    kind = f"<i{(depth + 7) // 8}"
    return [(at, len(some := samples[at : at + size]), some.astype(kind).tobytes()) for at in range(0, len(samples), size)]


def media_features(media: Column) -> Column:
    """What a column of 8-bit FLAC streams holds, decoded and verified: FEATURES; null for null.

    The payload is that of the stream's PCM blocks. A damaged stream, or one of another depth, stops the
    job; equal streams give equal values, and an empty table none.
    """

    @F.arrow_udf(FEATURES)
    def read(column: pa.Array) -> pa.Array:
        out: list = []
        for a, b in byte_batches(_sizes(column), BATCH_BYTES):
            streams = column.slice(a, b - a).to_pylist()
            decoded = iter(decode([x for x in streams if x is not None]))
            for stream in streams:
                if stream is None:
                    out.append(None)
                    continue
                samples, frames, info = next(decoded)
                if info["depth"] != 8:
                    raise ValueError(f"a stream of {info['depth']} bits a sample, not of 8")
                pieces = pcm_pieces(samples, 8)
                payload = b"".join(pcm for _, _, pcm in pieces).translate(_SIGNED)
                out.append({"pcm_blocks": len(pieces), "frames": len(frames), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "media_bytes": len(stream), "media_sha256": hashlib.sha256(stream).hexdigest(), "feature": feature(samples)})
        names = ["pcm_blocks", "frames", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.array(out, pa.struct(list(zip(names, kinds))))

    return read(media)


def pcm_blocks(df: DataFrame, identifier: str, media: str, samples: int = PCM_SAMPLES) -> DataFrame:
    """PCM blocks of each stream: identifier, block, sample_offset, n_samples, rate, depth and pcm.

    pcm has at most samples samples, signed little-endian; sample_offset counts from 0, so the block of
    a sample is found by its number alone. A null stream has no block; a damaged one stops the job.
    """
    schema = df.select(identifier).schema.simpleString()[len("struct<") : -1].replace(":", " ", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            for a, b in byte_batches(_sizes(column), BATCH_BYTES):
                streams = [(k, x) for k, x in zip(keys.slice(a, b - a), column.slice(a, b - a).to_pylist()) if x is not None]
                lines = []
                for (key, _), (x, _, info) in zip(streams, decode([x for _, x in streams])):
                    for number, (at, n, pcm) in enumerate(pcm_pieces(x, info["depth"], samples)):
                        lines.append((key.as_py(), number, at, n, info["rate"], info["depth"], pcm))
                if lines:
                    kinds = [keys.type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines), kinds)], [batch.schema.names[0], "block", "sample_offset", "n_samples", "rate", "depth", "pcm"])

    return df.select(identifier, media).mapInArrow(run, f"{schema}, block long, sample_offset long, n_samples long, rate long, depth long, pcm binary")
