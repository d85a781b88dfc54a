"""Product codes of vectors by Lloyd's algorithm over cover trees.

A vector's components become integers and are cut into equal parts; each part position has a codebook.
Vectors are held in chunks, a row each, with one cover tree a part position over the chunk's distinct
parts. A tree lies in preorder, so a subtree is a range and its count and sum are differences of
cumulative sums. In a round, a node whose ball lies nearer to one entry than to any other, by the
triangle inequality, gives its whole subtree to that entry; only the other nodes descend, with those
entries that are still possible. Spark adds up what chunks found: a row an entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, forget, give_back, written
from .simhash_dedup import salted_join

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a chunk, all trees of which are in memory at once; an Arrow batch of the job that builds them has no more.
CHUNK = BATCH_ROWS
#: A child's ball has at most this share of its parent's radius.
SHRINK = 0.5
#: So few points become children at once.
LEAVES = 4
#: Components beyond this (scaled) have no code: sums of squares stay within 64 bits.
MOST = 1 << 27
#: Of distances: far more than the rounding of doubles, so what is told apart by it is told apart exactly.
SLACK = 1e-6
#: So many labels are joined by broadcast.
MOST_LABELS = 100_000


class CoverTree:
    """A cover tree over distinct integer points, in preorder.

    points are the points, counts how often each occurs, ends where the subtree that begins at a node
    ends, radius the greatest distance from a node's point to one of its subtree. Children are told by
    their ends: a node's first child follows it, and the next follows where that one ends.
    """

    def __init__(self, points: np.ndarray, counts: np.ndarray, ends: np.ndarray, radius: np.ndarray):
        self.points, self.counts, self.ends, self.radius = points, counts, ends, radius
        self.total = np.concatenate([[0], np.cumsum(counts)])
        self.sums = np.zeros((len(points) + 1, points.shape[1]), np.int64)
        np.cumsum(points * counts[:, None], axis=0, out=self.sums[1:])

    @staticmethod
    def build(points: np.ndarray) -> tuple["CoverTree", np.ndarray]:
        """The tree over the distinct rows of points, and the node of each row.

        From its point, a node keeps what lies within SHRINK of its radius as its own inner part, which is divided
        in turn; of the rest, the first left becomes a child and takes what lies within that
        distance of it. So children lie further apart than the radius that they cover.
        """
        distinct, inverse, counts = np.unique(points, axis=0, return_inverse=True, return_counts=True)
        n = len(distinct)
        order, ends, radius = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        as_float = distinct.astype(np.float64)
        at = 0
        # Work to do, last first: (node or -1, its members, their distances) opens a node; (~node, None, None) closes it.
        todo: list[tuple] = [(-1, np.arange(n), None)] if n else []
        while todo:
            node, members, apart = todo.pop()
            if members is None:
                ends[~node] = at
                continue
            if node < 0:
                centre, members = members[0], members[1:]
                node, at = at, at + 1
                order[node] = centre
                apart = np.sqrt(((as_float[members] - as_float[centre]) ** 2).sum(1))
                radius[node] = apart.max(initial=0.0)
                todo.append((~node, None, None))
            if len(members) <= LEAVES:
                todo.extend((-1, members[k : k + 1], None) for k in range(len(members)))
                continue
            reach = apart.max() * SHRINK
            near = apart <= reach
            todo.append((node, members[near], apart[near]))
            rest = members[~near]
            while len(rest):
                own = ((as_float[rest] - as_float[rest[0]]) ** 2).sum(1) <= reach * reach
                todo.append((-1, rest[own], None))
                rest = rest[~own]
        place = np.zeros(n, np.int64)
        place[order] = np.arange(n)
        return CoverTree(distinct[order], counts[order], ends, radius), place[inverse.ravel()]

    def nearest(self, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(first, end, entry): ranges of nodes and the nearest entry (of equally near ones the first) of all points in them.

        The ranges are disjoint and hold every node. All nodes of one depth are compared at once.
        """
        nodes = np.zeros(min(1, len(self.points)), np.int64)
        possible = np.ones((len(nodes), len(entries)), bool)
        far = np.iinfo(np.int64).max
        while len(nodes):
            squares = np.full(possible.shape, far)
            row, entry = np.nonzero(possible)
            squares[row, entry] = ((self.points[nodes[row]] - entries[entry]) ** 2).sum(1)
            best = squares.argmin(1)
            apart = np.sqrt(squares.astype(np.float64))
            rows = np.arange(len(nodes))
            reach = apart[rows, best] + 2 * self.radius[nodes]
            possible &= apart <= (reach + SLACK * (1 + reach))[:, None]
            sure = possible.sum(1) == 1
            yield nodes[sure], self.ends[nodes[sure]], best[sure]
            open_ = nodes[~sure]
            yield open_, open_ + 1, best[~sure]
            nodes, up = self._children(open_)
            possible = possible[~sure][up]

    def _children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All children of some nodes, and for each its parent's place among them."""
        found, parents = [], []
        child, up = nodes + 1, np.arange(len(nodes))
        while len(child):
            left = child < self.ends[nodes[up]]
            child, up = child[left], up[left]
            found.append(child)
            parents.append(up)
            child = self.ends[child]
        return (np.concatenate(found), np.concatenate(parents)) if found else (nodes[:0], nodes[:0])


def _blob(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _tree_of(blob: bytes, width: int) -> CoverTree:
    n = len(blob) // (4 * width + 16)
    raw = np.frombuffer(blob, np.uint8)
    points, counts, ends, radius = np.split(raw, np.cumsum([4 * width * n, 4 * n, 4 * n]))
    return CoverTree(points.view("<i4").reshape(n, width).astype(np.int64), counts.view("<i4").astype(np.int64), ends.view("<i4").astype(np.int64), radius.view("<f8"))


def scaled(vector: Column) -> Column:
    """floor(SCALE * x) of each component, as doubles; null for a null vector or one with a null or non-finite component."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    odd = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~odd, F.transform(doubles, lambda x: F.floor(x * SCALE).cast("double")))


def cover_trees(vectors: DataFrame, parts: int, width: int, chunk: int = CHUNK) -> DataFrame:
    """Chunks of vectors (id, label, v): ids, labels, a cover tree a part position, and each vector's node in it; a table.

    A task cuts its rows into chunks as they come.
    """
    kind, label = (dict(vectors.dtypes)[c] for c in ("id", "label"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for at in range(0, len(batch), chunk):
                rows = batch.slice(at, chunk)
                points = pc.list_flatten(rows.column(2)).to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), parts, width)
                trees, nodes = [], []
                for k in range(parts):
                    tree, node = CoverTree.build(points[:, k])
                    trees.append(_blob(tree.points.astype("<i4"), tree.counts.astype("<i4"), tree.ends.astype("<i4"), tree.radius.astype("<f8")))
                    nodes.append(_blob(node.astype("<i4")))
                row = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.column(k)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(row + [pa.array([x], pa.list_(pa.binary())) for x in (trees, nodes)], ["ids", "labels", "trees", "nodes"])
        give_back()

    return written(vectors.select("id", "label", "v").mapInArrow(build, f"ids array<{kind}>, labels array<{label}>, trees array<binary>, nodes array<binary>"), "trees")


def _round(chunks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of the mean of its parts, or itself without any."""
    parts, entries, width = books.shape

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for trees in batch.column(0):
                for k, blob in enumerate(trees):
                    tree = _tree_of(blob.as_py(), width)
                    for first, end, entry in tree.nearest(books[k]):
                        np.add.at(counts[k], entry, tree.total[end] - tree.total[first])
                        np.add.at(sums[k], entry, tree.sums[end] - tree.sums[first])
        part, entry = np.nonzero(counts)
        held = pa.FixedSizeListArray.from_arrays(pa.array(sums[part, entry].ravel()), width).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), held], ["part", "entry", "n", "s"])
        give_back()

    found = chunks.select("trees").mapInArrow(gather, "part long, entry long, n long, s array<long>")
    sums = [F.sum(F.get("s", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
    new = books.copy()
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        new[r["part"], r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(width)]
    return new


def assigned(chunks: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code and error of every vector of the chunks."""
    parts, _, width = books.shape
    kind, label = (dict(chunks.dtypes)[c].removeprefix("array<").removesuffix(">") for c in ("ids", "labels"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for row in range(len(batch)):
                ids, labels, trees, nodes = (batch.column(k)[row].values for k in range(4))
                codes, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for k in range(parts):
                    tree = _tree_of(trees[k].as_py(), width)
                    own = np.zeros(len(tree.points), np.int64)
                    for first, end, entry in tree.nearest(books[k]):
                        size = end - first
                        at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                        own[at] = np.repeat(entry, size)
                    squares = ((tree.points - books[k][own]) ** 2).sum(1)
                    at = np.frombuffer(nodes[k].as_py(), "<i4")
                    codes[:, k] = own[at]
                    error += squares[at]
                shown = [c.tobytes().hex() for c in codes]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(shown, pa.string()), pa.array(error)], ["id", "label", "code", "error"])
        give_back()

    return chunks.select("ids", "labels", "trees", "nodes").mapInArrow(told, f"id {kind}, label {label}, code string, error long")


def books_digest(books: np.ndarray) -> str:
    """sha256 of all components as decimal numbers, by part, entry and place, joined by commas; lower-case hex."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decoded(code: Column, books: np.ndarray) -> Column:
    """The vector that a code stands for: its entries' components over SCALE, in the middle of their steps."""
    parts, _, _ = books.shape
    held = F.array(*[F.array(*[F.array(*[F.lit((float(x) + 0.5) / SCALE) for x in entry]) for entry in book]) for book in books])
    each = [F.get(F.get(held, F.lit(k)), F.conv(F.substring(code, 2 * k + 1, 2), 16, 10).cast("int")) for k in range(parts)]
    return F.flatten(F.array(*each))


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame | None, np.ndarray]:
    """The chunks of vectors (id, label, v as scaled() gives it) and their codebooks after so many rounds; None without a vector.

    A codebook begins as the parts of the vectors with the least ids (null ids last, of equal ids the least vector first).
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part, so entries must be 1 to 256")
    first = [r["v"] for r in vectors.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()]
    if not first:
        return None, np.zeros((parts, 0, 0), np.int64)
    if len(first[0]) % parts:
        raise ValueError(f"vectors of {len(first[0])} components can't be cut into {parts} equal parts")
    width = len(first[0]) // parts
    books = np.array(first).astype(np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    chunks = cover_trees(vectors, parts, width)
    for _ in range(rounds):
        books = _round(chunks, books)
    return chunks, books


def compress(df: DataFrame, identifier: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """identifier, code, error, label_error and codebooks_sha256 of the rows of df whose vector has finite components only.

    A row with a null vector or a null or non-finite component is dropped. Vectors must have as many
    components as most have that come first (the least identifier's); a vector of another length, or with
    a component beyond MOST / SCALE, has no part in the codebooks and null code and error. Rows that
    share an identifier are all coded. Rows without a label are a group of their own; so label_error is null only
    in a group without codes. An empty table gives no rows; other columns are not read.
    """
    rows = df.select(F.col(identifier).alias("id"), F.col(label).alias("label"), scaled(F.col(vector)).alias("v")).where("v IS NOT NULL")
    small = F.forall("v", lambda x: F.abs(x) < MOST) & (F.size("v") > 0)
    least = rows.where(small).orderBy(F.asc_nulls_last("id"), "v").select(F.size("v").alias("size")).first()
    fits = small & (F.size("v") == (least["size"] if least else -1))
    chunks, books = train(rows.where(fits), parts, entries, rounds)
    odd = rows.where(~fits).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = written(odd if chunks is None else assigned(chunks, books).unionByName(odd), "codes")
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    if sums.count() <= MOST_LABELS:
        named = sums.withColumnRenamed("label", "of_label")
        joined = coded.join(F.broadcast(named), F.col("label").eqNullSafe(F.col("of_label")))
    else:
        key = F.struct("label", F.col("label").isNull().alias("none")).cast("string")
        joined = salted_join(coded.withColumn("key", key), sums.select(key.alias("key"), "label_error"), "key", "id")
    return joined.select(F.col("id").alias(identifier), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
