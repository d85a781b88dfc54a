"""Substring deduplication by fixed-block anchors.

A window is `window` consecutive words of one document; what to remove are the words of windows that
also start in a document with a smaller identifier. Reference blocks are the non-overlapping blocks
of `(window + 1) // 2` words of every document: each window holds one whole. Every rolling block of
every document probes them. Around the hits, and there only, whole windows are compared, and windows
that lie next to each other join to maximal exact repeats.

Documents are dealt by hash into groups of bounded size, blocks by hash into buckets. A group sends
each bucket its distinct keys once, as one sorted, difference-coded string, so a passage that very many
documents share costs one key a group; a bucket answers with one bit a key.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
GROUP_BYTES = 8 << 20
BUCKET_KEYS = 1 << 20
ANCHOR_BITS = 40
#: Bytes of text for a task, and how often a row may repeat before its copies are judged as one.
TASK_BYTES = 64 << 20
REPEATS = 1000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MESSAGE = "bucket long, pid long, n long, keys binary, checks binary, more binary"
_REPLY = "pid long, bucket long, bits binary"


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers, each in as many bytes as the largest needs; the first byte says how many."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    return struct.pack("<Q", int(values[0])) + pack(np.diff(values)) if len(values) else b""


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    first = np.array(struct.unpack("<Q", data[:8]), np.uint64)
    return np.cumsum(np.concatenate([first, unpack(data[8:])]), dtype=np.uint64)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(29))


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


class _Group:
    """The documents of one group in the order of their identifiers, as words and word hashes."""

    def __init__(self, table: pa.Table, window: int):
        import xxhash

        self.window, self.block = window, (window + 1) // 2
        ids, texts = table.column("id").to_pylist(), table.column("text").cast(pa.large_binary()).to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
        self.ids = [ids[k] for k in order]
        self.words = [(texts[k] or b"").split() for k in order]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.first = np.cumsum(self.size) - self.size
        digest = xxhash.xxh3_128_digest
        both = np.frombuffer(b"".join([digest(w) for doc in self.words for w in doc]), ">u8").reshape(-1, 2)
        self.check, self.hash = both[:, 0].astype(np.uint64), both[:, 1].astype(np.uint64)
        self.copies = np.array(table.column("copies").to_pylist(), np.int64)[order] if ids else np.zeros(0, np.int64)
        self.number = np.repeat(np.arange(len(self.ids)), self.size)
        known = np.array([x is not None for x in self.ids], bool)
        self.usable = known[self.number] if len(known) else np.zeros(0, bool)

    def starts(self, size: int) -> np.ndarray:
        """Places of all runs of size words within one document that has an identifier."""
        n = len(self.hash)
        if n < size:
            return np.zeros(0, np.int64)
        return np.flatnonzero((self.number[: n - size + 1] == self.number[size - 1 :]) & self.usable[: n - size + 1])

    def rolling(self, size: int, places: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the runs of size words at some places, of the words' first or other 64-bit hashes."""
        words = self.hash if words is None else words
        total = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for k in range(size):
            total = total * _MUL + words[k : len(total) + k]
        return _mixed(total[places])

    def anchors(self, bits: int):
        """Of the rolling blocks: places, the distinct keys, each place's key, which keys are reference blocks."""
        places = self.starts(self.block)
        hashes = self.rolling(self.block, places)
        keys, of = np.unique(hashes >> np.uint64(64 - bits), return_inverse=True)
        indexed = np.zeros(len(keys), bool)
        indexed[of[(places - self.first[self.number[places]]) % self.block == 0]] = True
        return places, keys, of, indexed

    def candidates(self, replies: list[tuple[int, bytes]], bits: int, buckets: int) -> np.ndarray:
        """Flags of places at which a window starts that holds a block another document has."""
        places, keys, of, indexed = self.anchors(bits)
        live = np.zeros(len(keys), bool)
        edges = bucket_edges(keys, bits, buckets)
        for bucket, answer in replies:
            a, b = edges[bucket], edges[bucket + 1]
            live[a:b] = _flags(answer, b - a)
        low = np.full(len(keys), len(self.ids))
        high = np.full(len(keys), -1)
        np.minimum.at(low, of, self.number[places])
        np.maximum.at(high, of, self.number[places])
        live |= indexed & (low < high)
        n = len(self.hash)
        hit = np.zeros(n + 1, np.int64)
        hit[places[live[of]] + 1] = 1
        hit = np.cumsum(hit)
        starts = self.starts(self.window)
        span = self.window - self.block + 1
        flags = np.zeros(n, bool)
        flags[starts[hit[starts + span] > hit[starts]]] = True
        return flags

    def windows(self, flags: np.ndarray):
        """Of the flagged windows: places, distinct hashes in order, their other hashes, each place's number
        among them, each one's first document. Windows are the same if both hashes are, 128 bits of them."""
        places = self.starts(self.window)
        places = places[flags[places]]
        hashes, checks = self.rolling(self.window, places), self.rolling(self.window, places, self.check)
        order = np.lexsort((checks, hashes))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(hashes[order]) != 0) | (np.diff(checks[order]) != 0)
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        first = order[new]
        return places, hashes[first], checks[first], of, self.number[places[first]]


def bucket_edges(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin among sorted keys of so many bits; buckets are ranges of equal width."""
    width = ((1 << bits) + buckets - 1) // buckets
    return np.searchsorted(keys, np.array([min(k * width, (1 << 64) - 1) for k in range(buckets)] + [(1 << 64) - 1], np.uint64))


def _messages(pid: int, keys: np.ndarray, checks: np.ndarray, more, bits: int, buckets: int) -> Iterator[dict]:
    edges = bucket_edges(keys, bits, buckets)
    for bucket in np.flatnonzero(np.diff(edges)):
        a, b = edges[bucket], edges[bucket + 1]
        yield {"bucket": int(bucket), "pid": pid, "n": int(b - a), "keys": pack_sorted(keys[a:b]), "checks": checks[a:b].astype("<u8").tobytes(), "more": more(a, b)}


_MESSAGE_SCHEMA = pa.schema([("bucket", pa.int64()), ("pid", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("checks", pa.binary()), ("more", pa.binary())])
_REPLY_SCHEMA = pa.schema([("pid", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])


def _answered(table: pa.Table, decide) -> pa.Table:
    """One reply for each message with any bit set. decide(order of all keys, starts of runs of equal ones, messages) gives flags in that order."""
    sent = table.to_pylist()
    keys = np.concatenate([unpack_sorted(m["keys"]) for m in sent])
    if sent[0]["checks"]:
        checks = np.concatenate([np.frombuffer(m["checks"], "<u8") for m in sent])
        order = np.lexsort((checks, keys))
        starts = np.flatnonzero(np.r_[True, (np.diff(keys[order]) != 0) | (np.diff(checks[order]) != 0)])
    else:
        order = np.argsort(keys, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(keys[order]) != 0])
    flags = np.zeros(len(keys), bool)
    flags[order] = decide(order, starts, sent)
    out, at = [], 0
    for m in sent:
        own = flags[at : at + m["n"]]
        at += m["n"]
        if own.any():
            out.append({"pid": m["pid"], "bucket": m["bucket"], "bits": _bits(own)})
    return pa.Table.from_pylist(out, schema=_REPLY_SCHEMA)


def repeats(df: DataFrame, identifier: str = "doc_id", text: str = "text", window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id (named as identifier), n_words, n_removed, spans and kept of every row of df.

    Words are runs of [^\\x20\\x09-\\x0D], unchanged. spans are the maximal runs of removed words, as
    (first, last) word numbers from 0, and kept is the words that stay, joined by one space. Windows
    are judged on the input. A null text has no words. A row whose identifier is null is neither
    smaller nor larger than others: it loses nothing and takes nothing. Rows with equal identifiers
    do not remove from each other. All rows are returned, repeated ones too; an empty table gives none.

    Anchors are compared by ANCHOR_BITS bits of their hash, which may let more windows through to the
    comparison but none fewer; windows are compared by two independent hashes of 64 bits each, so that
    among 10^13 windows two different ones pass for the same with a probability of some 10^-13.
    An identifier must be an integer or cast to one (a text that does not stops the job); other columns
    are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(identifier).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    counted = rows.groupBy("id", F.xxhash64("text").alias("hash")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    total, often = (x or 0 for x in counted.agg(F.sum("bytes"), F.max("n")).first())
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, -(-total // TASK_BYTES))
    groups = max(tasks, -(-total // group_bytes))
    buckets = max(tasks, -(-total // (6 * BUCKET_KEYS)))
    bits = ANCHOR_BITS if total < 1 << 40 else 56
    # Copies of one row have one result: where they are many they are judged once, or they would all meet in one group.
    rows = rows.groupBy("id", "text").agg(F.count("*").alias("copies")) if often > REPEATS else rows.withColumn("copies", F.lit(1).cast("long"))
    dealt = rows.withColumn("pid", F.pmod(F.xxhash64("id", "text"), F.lit(groups))).repartition(tasks, "pid")
    none = np.zeros(0, np.uint64)

    def ask_anchors(key: tuple, table: pa.Table) -> pa.Table:
        _, keys, _, indexed = _Group(table, window).anchors(bits)
        return pa.Table.from_pylist(list(_messages(key[0].as_py(), keys, none, lambda a, b: _bits(indexed[a:b]), bits, buckets)), schema=_MESSAGE_SCHEMA)

    def tell_anchors(table: pa.Table) -> pa.Table:
        def shared(order, starts, sent):
            indexed = np.concatenate([_flags(m["more"], m["n"]) for m in sent])[order]
            length = np.diff(np.r_[starts, len(order)])
            return np.repeat((length > 1) & np.logical_or.reduceat(indexed, starts), length)

        return _answered(table, shared)

    def ask_windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_pylist([], schema=_MESSAGE_SCHEMA)
        pid = table.column("pid")[0].as_py()
        group = _Group(table, window)
        flags = group.candidates([(r["bucket"], r["bits"]) for r in replies.to_pylist()], bits, buckets)
        _, keys, checks, _, first = group.windows(flags)
        ids = np.array([0 if x is None else x for x in group.ids], np.int64)[first].view(np.uint64) ^ np.uint64(1 << 63)

        def owners(a: int, b: int) -> bytes:
            low = ids[a:b].min()
            return struct.pack("<Q", int(low)) + pack(ids[a:b] - low)

        out = list(_messages(pid, keys, checks, owners, 64, buckets))
        out.append({"bucket": -1 - pid, "pid": pid, "n": len(flags), "keys": b"", "checks": b"", "more": _bits(flags)})
        return pa.Table.from_pylist(out, schema=_MESSAGE_SCHEMA)

    def tell_windows(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:  # the group's own candidates, which go back as they are
            return table.select(["pid", "bucket", "more"]).rename_columns(["pid", "bucket", "bits"]).cast(_REPLY_SCHEMA)

        def later(order, starts, sent):
            owner = np.concatenate([unpack(m["more"][8:]) + np.uint64(struct.unpack("<Q", m["more"][:8])[0]) for m in sent])[order]
            length = np.diff(np.r_[starts, len(order)])
            return owner > np.repeat(np.minimum.reduceat(owner, starts), length)

        return _answered(table, later)

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        schema = pa.schema([(identifier, pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("kept", pa.string()), ("copies", pa.int64())])
        if not table.num_rows:
            return pa.Table.from_pylist([], schema=schema)
        group = _Group(table, window)
        answers = {r["bucket"]: r["bits"] for r in replies.to_pylist()}
        own = next(v for k, v in answers.items() if k < 0)
        places, keys, _, of, first = group.windows(_flags(own, len(group.hash)))
        late = np.zeros(len(keys), bool)
        edges = bucket_edges(keys, 64, buckets)
        for bucket, bits_ in answers.items():
            if bucket >= 0:
                a, b = edges[bucket], edges[bucket + 1]
                late[a:b] = _flags(bits_, b - a)
        ids = np.array([0 if x is None else x for x in group.ids], np.int64)
        gone = places[late[of] | (ids[group.number[places]] > ids[first][of])]
        cover = np.zeros(len(group.hash) + 1, np.int64)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + window, -1)
        covered = np.cumsum(cover[:-1]) > 0
        removed, spans, kept = [], [], []
        for words, at in zip(group.words, group.first.tolist()):
            mask = covered[at : at + len(words)]
            if mask.any():
                edge = np.diff(np.r_[False, mask, False].astype(np.int8))
                spans.append([{"first": int(a), "last": int(b) - 1} for a, b in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0))])
                words = [w for w, m in zip(words, mask.tolist()) if not m]
            else:
                spans.append([])
            removed.append(int(mask.sum()))
            kept.append(b" ".join(words))
        return pa.Table.from_arrays([pa.array(group.ids, pa.int64()), pa.array(group.size), pa.array(removed, pa.int64()), pa.array(spans, schema.field("spans").type), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(group.copies)], schema=schema)

    def meet(messages: DataFrame, tell) -> DataFrame:
        return messages.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(tell, _REPLY)

    anchors = meet(dealt.groupBy("pid").applyInArrow(ask_anchors, _MESSAGE), tell_anchors)
    asked = dealt.groupBy("pid").cogroup(anchors.groupBy("pid")).applyInArrow(ask_windows, _MESSAGE)
    windows = meet(asked, tell_windows)
    out = dealt.groupBy("pid").cogroup(windows.groupBy("pid")).applyInArrow(cut, f"`{identifier}` long, n_words long, n_removed long, spans array<struct<first long, last long>>, kept string, copies long")
    told = [F.col(f"`{identifier}`"), "n_words", "n_removed", "spans", "kept"]
    if often > REPEATS:
        out = out.select(*told, F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(*told)
