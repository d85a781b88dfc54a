"""Token shards as sorted string tables.

A shard holds entries in ascending key order. Its layout:

    data blocks | Bloom filter | block index | footer

A block is zstd-compressed and followed by the crc32 of what is stored. Inside, each entry is
varint(bytes shared with the key before), varint(bytes not shared), varint(value bytes), the rest of
the key, the value; the first entry of a block shares nothing. The index has one line per block: its
first key, place, entries and the tokens before it in the shard, so a key is found by binary search
over the index and a scan of one block. Values are token ids, little-endian, 2 or 4 bytes each.

A key is 13 bytes: 0 for a null identifier, else 1; the identifier as big-endian two's complement
with the sign bit flipped; a big-endian counter that tells rows with the same identifier apart.
"""

from __future__ import annotations

import bisect
import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_batches, fresh_dir, give_back, written
from .encoding import json_encoder

BLOCK_BYTES = 64 << 10
BATCH_BYTES = 1 << 20
#: A task begins a new shard when the one at hand is longer than this.
SHARD_BYTES = 1 << 30
BITS_PER_KEY = 10
PROBES = 7
MAGIC = b"MRSST001"
FOOTER = struct.Struct("<QQQQQQIIII8s")  # index at, length; filter at, length; entries; tokens; width; blocks; crc of index; crc of filter; magic


def make_key(identifier: int | None, copy: int = 0) -> bytes:
    if identifier is None:
        return b"\0" + struct.pack(">QI", 0, copy)
    return b"\1" + struct.pack(">QI", (identifier + (1 << 63)) & 0xFFFFFFFFFFFFFFFF, copy)


def key_identifier(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    if n < 128:
        return bytes((n,))
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _filter_places(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return [(a + k * b) % bits for k in range(PROBES)]


class ShardWriter:
    """Writes entries, given in ascending key order, to a binary stream."""

    def __init__(self, out, width: int, block_bytes: int = BLOCK_BYTES):
        import zstandard

        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.at = self.entries = self.tokens = 0
        self.first = self.last = None
        self.keys: list[bytes] = []
        self.index: list[tuple[bytes, int, int, int, int]] = []
        self._new_block()

    def _new_block(self) -> None:
        self.block, self.held, self.block_first, self.block_tokens, self.previous, self.block_entries = [], 0, None, self.tokens, b"", 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.last is not None and key <= self.last:
            raise ValueError("keys must ascend")
        shared = 0
        for x, y in zip(self.previous, key):
            if x != y:
                break
            shared += 1
        head = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += (head, value)
        self.held += len(head) + len(value)
        if self.block_first is None:
            self.block_first = key
        self.first = key if self.first is None else self.first
        self.last = self.previous = key
        self.keys.append(key)
        self.entries += 1
        self.block_entries += 1
        self.tokens += len(value) // self.width
        if self.held >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            stored = self.pack(b"".join(self.block))
            self.out.write(stored)
            self.out.write(struct.pack("<I", zlib.crc32(stored)))
            self.index.append((self.block_first, self.at, len(stored), self.block_entries, self.block_tokens))
            self.at += len(stored) + 4
            self._new_block()

    def close(self) -> int:
        """Writes filter, index and footer; gives the bytes of the shard."""
        self._flush()
        bits = max(64, BITS_PER_KEY * self.entries)
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _filter_places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom = struct.pack("<Q", bits) + bytes(bloom)
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) + _varint(entries) + _varint(before) for k, at, n, entries, before in self.index)
        self.out.write(bloom)
        self.out.write(index)
        self.out.write(FOOTER.pack(self.at + len(bloom), len(index), self.at, len(bloom), self.entries, self.tokens, self.width, len(self.index), zlib.crc32(index), zlib.crc32(bloom), MAGIC))
        return self.at + len(bloom) + len(index) + FOOTER.size


class ShardReader:
    """Reads a shard from a seekable binary stream of the given size; every part's crc32 is checked."""

    def __init__(self, stream, size: int):
        import zstandard

        self.stream, self.unpack = stream, zstandard.ZstdDecompressor().decompress
        index_at, index_n, bloom_at, bloom_n, self.entries, self.tokens, self.width, blocks, index_crc, bloom_crc, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("no shard of this format")
        index, self.bloom = self._at(index_at, index_n), self._at(bloom_at, bloom_n)
        if zlib.crc32(index) != index_crc or zlib.crc32(self.bloom) != bloom_crc:
            raise ValueError("damaged index or filter")
        self.index = []
        at = 0
        for _ in range(blocks):
            n, at = _read_varint(index, at)
            key = index[at : at + n]
            at += n
            line = []
            for _ in range(4):
                value, at = _read_varint(index, at)
                line.append(value)
            self.index.append((key, *line))
        self.firsts = [x[0] for x in self.index]

    def _at(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def block(self, number: int) -> Iterator[tuple[bytes, bytes]]:
        _, place, n, entries, _ = self.index[number]
        stored = self._at(place, n + 4)
        if zlib.crc32(stored[:-4]) != struct.unpack("<I", stored[-4:])[0]:
            raise ValueError(f"damaged block {number}")
        data, at, key = self.unpack(stored[:-4]), 0, b""
        for _ in range(entries):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}")

    def may_hold(self, key: bytes) -> bool:
        bits = struct.unpack("<Q", self.bloom[:8])[0]
        return all(self.bloom[8 + (p >> 3)] >> (p & 7) & 1 for p in _filter_places(key, bits))

    def get(self, identifier: int | None, copy: int = 0) -> np.ndarray | None:
        """Ids of one document, by Bloom filter, binary search over the index and one block."""
        key = make_key(identifier, copy)
        at = bisect.bisect_right(self.firsts, key) - 1
        if at >= 0 and self.may_hold(key):
            for k, value in self.block(at):
                if k == key:
                    return self.ids(value)
        return None


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or ":" in uri.split("/")[0] else f"file://{uri}")


def _encoded(batch: pa.RecordBatch, path: str, end_id: int | None) -> Iterator[tuple[int | None, bytes]]:
    encoder = json_encoder(path)
    end = b"" if end_id is None else end_id.to_bytes(encoder.width, "little")
    ids, column = batch.column(0).to_pylist(), batch.column(1)
    sizes = pc.fill_null(pc.binary_length(column.cast(pa.large_binary())), 0).to_pylist()
    for a, b in byte_batches(sizes, BATCH_BYTES):
        data, edges = encoder.encode(column.slice(a, b - a))
        for k, i, j in zip(range(a, b), edges.tolist(), edges[1:].tolist()):
            yield ids[k], bytes(data[i:j]) + end
        data = None
    give_back()


MANIFEST = "shard long, path string, entries long, tokens long, bytes long, first_key binary, last_key binary"
_MANIFEST = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("entries", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary())])


def write_shards(df: DataFrame, path: str, directory: str, identifier: str = "doc_id", text: str = "text", end_id: int | None = 0, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes every whole text and writes shards under directory; gives the manifest, itself a table there.

    path names a .json file of the tokenizers library; end_id (None: nothing) ends each document.
    Rows are range-partitioned and sorted by identifier; a partition streams into one shard, and into the
    next when that has shard_bytes, so that shards in their order hold all documents in ascending order.
    An identifier must be an integer or cast to one (a text that does not stops the job). A null identifier sorts first, a null or
    empty text is the end id alone, rows that share an identifier are all kept, told apart by a
    counter, and an empty table has no shard. Other columns are not read.

    Every attempt of a task writes a file of its own name. The manifest, committed by Spark's own
    writer, names one finished attempt per shard; files of lost attempts are never referred to.
    """
    rows = df.select(F.col(identifier).cast("long").alias("id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("tie"))
    placed = rows.repartitionByRange(F.asc_nulls_first("id"), F.asc("tie")).sortWithinPartitions(F.asc_nulls_first("id"), "tie").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, name = TaskContext.get().partitionId() << 20, ""
        writer = stream = None
        last, copies = object(), 0

        def finished() -> pa.RecordBatch:
            size = writer.close()
            stream.close()
            line = {"shard": shard, "path": f"{directory}/{name}", "entries": writer.entries, "tokens": writer.tokens, "bytes": size, "first_key": writer.first, "last_key": writer.last}
            return pa.RecordBatch.from_pylist([line], schema=_MANIFEST)

        for batch in batches:
            for key, value in _encoded(batch, path, end_id):
                if writer is not None and writer.at > shard_bytes and key != last:
                    yield finished()
                    writer, shard = None, shard + 1
                if writer is None:
                    system, base = _opened(directory)
                    system.create_dir(base, recursive=True)
                    name = f"shard-{shard:012x}-{uuid.uuid4().hex}.sst"
                    stream = system.open_output_stream(f"{base}/{name}")
                    writer = ShardWriter(stream, json_encoder(path).width, block_bytes)
                copies = copies + 1 if key == last else 0
                last = key
                writer.add(make_key(key, copies), value)
        if writer is not None:
            yield finished()

    return written(placed.mapInArrow(write, MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the shards.

    start counts the ids of all documents before, over all shards; n_tokens has the end id;
    ids_crc32 is the crc32 of the ids as little-endian unsigned 32-bit integers. The manifest has one
    row a shard, so its running sum is small whatever the documents are.
    """
    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.select("path", "bytes", F.coalesce(before, F.lit(0)).alias("before"))
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                system, name = _opened(path)
                with system.open_input_file(name) as stream:
                    shard = ShardReader(stream, size)
                    for number in range(len(shard.index)):
                        out: list[list] = [[], [], [], []]
                        for key, value in shard.block(number):
                            ids = shard.ids(value)
                            for column, x in zip(out, (key_identifier(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                                column.append(x)
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, identifiers: list[int]) -> dict[int, list[np.ndarray]]:
    """Ids of some documents by key: the shard by its key range, then filter, index and block.

    The manifest's lines for the wanted keys come to the driver; the shards are read by place.
    """
    found: dict[int, list[np.ndarray]] = {}
    for identifier in identifiers:
        key = make_key(identifier)
        lines = manifest.where((F.lit(make_key(identifier, 0xFFFFFFFF)) >= F.col("first_key")) & (F.lit(key) <= F.col("last_key"))).orderBy("shard").collect()
        copy = 0
        for line in lines:
            system, name = _opened(line["path"])
            with system.open_input_file(name) as stream:
                shard = ShardReader(io.BufferedReader(stream), line["bytes"])
                copy = 0
                while (ids := shard.get(identifier, copy)) is not None:
                    found.setdefault(identifier, []).append(ids)
                    copy += 1
    return found


def encode_to_shards(df: DataFrame, path: str, directory: str | None = None, **options) -> DataFrame:
    """write_shards() into directory, or a new one in the shared folder."""
    return write_shards(df, path, directory or fresh_dir(df.sparkSession, "sst"), **options)
