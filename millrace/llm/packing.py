"""Best-fit decreasing packing of documents into sequences of bounded length.

Pieces of equal length are interchangeable, so the histogram of lengths (at most one row a length,
whatever the corpus) decides the whole packing: plan() runs best-fit decreasing over it, finding the
tightest open sequence for each document by a segment tree over remaining capacities. What it gives
are runs: ranks from .. to of one length go into sequences numbered in a row. Spark ranks the pieces
of each length and every piece finds its run by binary search, so no task sees more than its own pieces.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import byte_batches, forget, give_back, written
from .encoding import json_encoder

CAPACITY = 1024
BATCH_BYTES = 1 << 20
#: More capacity would make histogram and plan too long for the driver.
MOST_CAPACITY = 1 << 17
_PLACE = StructType([StructField("sequence_id", LongType()), StructField("offset", LongType())])


class OpenSequences:
    """Open sequences by remaining capacity, and a segment tree that finds the tightest one in logarithmic time.

    Sequences of one remaining capacity are kept as ranges of numbers; a leaf of the tree is a
    capacity, and a node tells whether any sequence is open below it.
    """

    def __init__(self, capacity: int):
        self.ranges: list[deque] = [deque() for _ in range(capacity + 1)]
        self.leaves = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.leaves)

    def _mark(self, remaining: int) -> None:
        k = self.leaves + remaining
        self.tree[k] = bool(self.ranges[remaining])
        while k > 1:
            k //= 2
            self.tree[k] = self.tree[2 * k] | self.tree[2 * k + 1]

    def add(self, remaining: int, first: int, count: int) -> None:
        if remaining and count:
            self.ranges[remaining].append((first, count))
            self._mark(remaining)

    def take(self, remaining: int) -> tuple[int, int]:
        """The range that has been open longest."""
        found = self.ranges[remaining].popleft()
        self._mark(remaining)
        return found

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open sequence that is at least length."""
        k = self.leaves + length
        if length < len(self.ranges) and self.tree[k]:
            return length
        while k > 1:
            if not k & 1 and self.tree[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.tree[2 * k] else 2 * k + 1
                return k - self.leaves
            k //= 2
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over counts by length: rows (length, first rank, first sequence, offset, per).

    From first rank on, each sequence from first sequence on gets per pieces of that length, beginning
    at offset; a run ends where the next of its length begins. Within a length the tightest sequence
    stays the tightest while another piece fits, so a range of equal sequences is filled one after the
    other, which is what best-fit does piece by piece. A length splits one range at most, so there
    are not over two ranges a length, and a range is met by not over sqrt(2 * capacity) lengths.
    """
    opened, runs, next_ = OpenSequences(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            remaining = opened.tightest(length)
            if remaining is None:
                remaining, first, count = capacity, next_, -(-left // (capacity // length))
                next_ += count
            else:
                first, count = opened.take(remaining)
            per = remaining // length
            whole = min(count, left // per)
            rest = min(left - whole * per, per) if whole < count else 0
            runs.append((length, rank, first, capacity - remaining, per))
            opened.add(remaining - per * length, first, whole)
            if rest:
                opened.add(remaining - rest * length, first + whole, 1)
            opened.add(remaining, first + whole + bool(rest), count - whole - bool(rest))
            rank, left = rank + whole * per + rest, left - whole * per - rest
    return np.array(runs, np.int64).reshape(-1, 5)


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole sequences, and before them what is over."""
    whole, over = divmod(n, capacity)
    return [over] * bool(over) + [capacity] * whole


def pieces(df: DataFrame, path: str, identifier: str = "doc_id", text: str = "text", end_id: int | None = 2, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """The pieces of every whole text, a table: doc_id, piece, start, length, ids_crc32, part and place, and ids if wanted.

    path names a .json file of the tokenizers library; end_id ends each document (None: nothing does,
    and a document without ids has no piece). A document of more ids than capacity is cut into pieces
    of capacity ids, the first of which may be shorter. ids are little-endian unsigned 32-bit
    integers. part and place number the pieces of one length within a task.
    """
    if not 0 < capacity <= MOST_CAPACITY:
        raise ValueError(f"capacity must be 1 to {MOST_CAPACITY}")
    rows = df.select(F.col(identifier).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    end = np.array([] if end_id is None else [end_id], "<u4")
    names = ["piece", "start", "length", "ids_crc32", "place"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            texts = batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts.cast(pa.large_binary())), 0).to_pylist()
            encoder = json_encoder(path)
            for a, b in byte_batches(sizes, BATCH_BYTES):
                data, edges = encoder.encode(texts.slice(a, b - a))
                row, numbers, blobs = [], {n: [] for n in names}, []
                edges = (edges // encoder.width).tolist()
                ids = np.frombuffer(data, f"<u{encoder.width}").astype("<u4")
                for k, (i, j) in enumerate(zip(edges, edges[1:])):
                    own = np.concatenate([ids[i:j], end])
                    start = 0
                    for number, length in enumerate(piece_lengths(len(own), capacity)):
                        blob = own[start : start + length].tobytes()
                        row.append(a + k)
                        for n, v in zip(names, (number, start, length, zlib.crc32(blob), int(seen[length]))):
                            numbers[n].append(v)
                        if with_ids:
                            blobs.append(blob)
                        seen[length] += 1
                        start += length
                data = ids = None
                columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(numbers["piece"], pa.int32()), *[pa.array(numbers[n], pa.int64()) for n in names[1:]], pa.array([part] * len(row), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(blobs, pa.binary())] * with_ids, ["doc_id", *names, "part"] + ["ids"] * with_ids)
        give_back()

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, place long, part int" + ", ids binary" * with_ids
    return written(rows.mapInArrow(cut, schema), "pieces")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of pieces() with sequence_id and offset: as few sequences as best-fit decreasing makes of all pieces.

    Pieces of one length are ranked by a running sum over tasks (one row a task and length). The
    histogram and the plan come to the driver; their sizes depend on capacity alone.
    """
    counts = written(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select(F.col("length").alias("of_length"), F.col("part").alias("of_part"), F.coalesce(before, F.lit(0)).alias("base"))
    runs = plan(histogram, capacity)
    order = np.lexsort((runs[:, 1], -runs[:, 0]))
    runs = runs[order]
    # Lengths fall and ranks rise: one number for both keeps the runs sorted.
    rises = np.concatenate([[0], np.cumsum([histogram[n] for n in sorted(histogram, reverse=True)])]).astype(np.int64)
    place_of = np.zeros(capacity + 1, np.int64)
    place_of[sorted(histogram, reverse=True)] = rises[:-1]
    keys = place_of[runs[:, 0]] + runs[:, 1]

    @F.arrow_udf(_PLACE)
    def placed(length: pa.Array, rank: pa.Array) -> pa.Array:
        forget()
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        at = np.searchsorted(keys, place_of[lengths] + ranks, "right") - 1
        _, first, sequence, offset, per = runs[at].T
        past = ranks - first
        return pa.StructArray.from_arrays([pa.array(sequence + past // per), pa.array(offset + past % per * lengths)], ["sequence_id", "offset"])

    ranked = cut.join(bases, (F.col("length") == F.col("of_length")) & (F.col("part") == F.col("of_part")))
    told = ranked.withColumn("p", placed(F.col("length"), F.col("base") + F.col("place")))
    own = [c for c in cut.columns if c not in ("part", "place")]
    return told.select(*own, "p.sequence_id", "p.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids of every sequence; a group is one sequence, so never over capacity ids."""
    held = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("held"))
    whole = F.aggregate("held", F.lit(b"").cast("binary"), lambda out, x: F.concat(out, x["ids"]))
    return held.select("sequence_id", "length", whole.alias("ids"))


def pack_documents(df: DataFrame, path: str, identifier: str = "doc_id", text: str = "text", end_id: int | None = 2, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """pack() of pieces(): one row a piece with the sequence and the offset where it lies.

    Every row of df is a document of its own, repeated rows and null identifiers too; a null or empty
    text is the end id alone. Sequences are filled from offset 0 without gaps. Other columns are not
    read; an empty table gives no rows.
    """
    return pack(pieces(df, path, identifier, text, end_id, capacity, with_ids), capacity)
