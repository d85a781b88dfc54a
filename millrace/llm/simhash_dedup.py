"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into floor(radius / 2) + 1 segments, so that of two fingerprints within
radius at least one segment differs by at most one bit. Each segment is indexed once for each of its
bits, with that bit a wildcard: two segments that differ by at most one bit share such a variant.
Fingerprints meet by equality on (segment, wildcard, other bits) and the distance is verified.
"""

from __future__ import annotations

import weakref
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import byte_batches, discard, forget, free_name, small_batches, written

SHINGLE = 4
RADIUS = 4
BATCH_BYTES = 1 << 20
#: A bucket of more members is compared by blocks of equal bits instead of all with all.
BUCKET = 4096
#: Places that a key stands in where a star's centre would meet all its leaves in one task.
SALTS = 8
#: A fingerprint of more rows than this, and than a HOT_SHARE-th of all, is joined by broadcast: at most HOT_SHARE of them.
HOT_ROWS, HOT_SHARE = 10_000, 50_000
#: The pipeline's stage links texts by the Jaccard similarity of their five-word shingles.
SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
#: Shingles of at least COMMON_IN of about SAMPLE_TEXTS texts come last in prefixes (the MOST_COMMON of them).
SAMPLE_TEXTS, COMMON_IN, MOST_COMMON, CHUNK_SHINGLES = 50_000, 4, 200_000, 500_000
#: Bits of a set's sketch: the parity of the shingles at each place. Two sketches differ in no more bits than their sets in shingles.
SKETCH_BITS = 1024
#: Places that a common shingle's rows are dealt over.
COMMON_SALTS = 64
#: Members of a key that meet in one task; more are dealt into parts.
RUN = 100_000
#: Pairs that a task gathers before it gives them on, each once.
PAIRS = 1 << 20
#: Members of a key of more than CROWD are first compared with the nearest of another root alone, as long as a WORTH-th of these pairs are links.
CROWD, WORTH = 64, 10
#: What tells a row of documents: its identifier (null: after all others) and two hashes of its text.
_ROW = ["row_id", "text_hash", "text_hash_2"]
#: A set of more shingles than SKETCH_BITS has a wide sketch too, of a bit a shingle or up to twice that, at most WIDE_BITS.
WIDE_BITS = 1 << 17
_SIGNED = StructType([*[StructField(n, LongType()) for n in ("node", "size", "rare", "fp")], *[StructField(n, ArrayType(LongType())) for n in ("prefix", "sketch", "wide")]])
_SPACE = bytes(range(9, 14)) + b" "
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SQUEEZE = bytes(32 if b in _SPACE else _LOWER[b] for b in range(256))


def fingerprint_of(text: bytes | None, size: int = SHINGLE) -> int:
    """The fingerprint of one text (UTF-8), unsigned; 0 if it has no word.

    A-Z are lower-cased, words are runs of [^\\x20\\x09-\\x0D], shingles are size words joined by one
    space (a shorter text: all its words), repeats count. A bit is 1 if it is set in over half of the
    shingles' XXH64 (seed 42).
    """
    import xxhash

    found = (text or b"").translate(_SQUEEZE).split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = [0, *ends[:-1].tolist()]
    tails = (ends - 1).tolist()[size - 1 :] or [len(line)]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    count = len(tails)
    for at in range(0, count, 1 << 16):
        hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts[at:], tails[at : at + (1 << 16)])], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view("<u8")[0])


@F.arrow_udf(LongType())
def _fingerprints(column: pa.Array) -> pa.Array:
    forget()
    sizes = pc.fill_null(pc.binary_length(column.cast(pa.large_binary())), 0).to_pylist()
    out: list[int] = []
    for a, b in byte_batches(sizes, BATCH_BYTES):
        out += [fingerprint_of(x) for x in column.slice(a, b - a).cast(pa.large_binary()).to_pylist()]
    return pa.array(np.array(out, np.uint64).view(np.int64))


def fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """df with the fingerprint of every whole text, its 64 bits as a long; a null text has 0."""
    return df.withColumn(name, _fingerprints(F.col(text)))


def segments(radius: int = RADIUS, bits: int = 64) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs by at most one bit."""
    n = max(2, radius // 2 + 1)
    edges = [bits * k // n for k in range(n + 1)]
    return list(zip(edges, (b - a for a, b in zip(edges, edges[1:]))))


def variants(fingerprint: Column, radius: int = RADIUS) -> Column:
    """All one-wildcard variants of all segments, as an array of longs.

    Each holds the wildcard's place among the 64 bits and the segment with that bit cleared, so it
    names its segment too.
    """
    keys = []
    for first, width in segments(radius):
        part = F.shiftrightunsigned(fingerprint, first).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            rest = part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit)))
            keys.append(rest + F.lit((first + bit) << 40))
    return F.array(*keys)


def _forest(members: np.ndarray, radius: int, block: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what is linked within one bucket: at most one less than its members.

    Breadth first from the smallest member not yet reached: each reached one is compared, in
    blocks, with those not reached, so no pair is compared twice and memory is a block's.
    """
    if len(members) > BUCKET:
        yield from _forest_by_blocks(members, radius)
        return
    rest = np.sort(members)
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            reached = np.zeros(len(rest), bool)
            by = np.zeros(len(rest), np.uint64)
            for at in range(0, len(front), 64):
                some = front[at : at + 64]
                left = np.flatnonzero(~reached)
                for b in range(0, len(left), block):
                    here = left[b : b + block]
                    near = np.bitwise_count(rest[here][:, None] ^ some[None, :]) <= radius
                    hit = near.any(1)
                    by[here[hit]] = some[near[hit].argmax(1)]
                    reached[here[hit]] = True
            yield by[reached], rest[reached]
            front, rest = rest[reached], rest[~reached]


def _forest_by_blocks(members: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """_forest() of a large bucket: of radius + 1 blocks of bits two members within radius have one in common.

    Members of one block value are compared; what is compared so is a 2^-12th of all pairs, unless
    members are near copies of each other, which a few steps reach.
    """
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    for a, b in zip(edges, edges[1:]):
        value = members >> np.uint64(a) & np.uint64((1 << (b - a)) - 1)
        order = np.lexsort((members, value))
        starts = np.flatnonzero(np.r_[True, np.diff(value[order]) != 0])
        for start, end in zip(starts, np.r_[starts[1:], len(order)]):
            rest = members[order[start:end]]
            while len(rest) > 1:
                # Breadth first from the least member, one reached member at a time where few are left to reach.
                front, rest = rest[:1], rest[1:]
                while len(front) and len(rest):
                    centre, front = front[:1], front[1:]
                    near = np.bitwise_count(rest ^ centre) <= radius
                    if near.any():
                        found, rest = rest[near], rest[~near]
                        yield np.repeat(centre, len(found)), found
                        front = np.concatenate([front, found])


def salted_join(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """left joined with right, which has one row a key; a key's rows of left are dealt over SALTS places by another column."""
    dealt = left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [key, "salt"]).drop("salt")


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that span every link within radius.

    Fingerprints meet in buckets of equal variants. A bucket gives a forest of verified links, not
    all its pairs, so a large group of near copies gives as many edges as members; the connected
    components are those of all links. Buckets come as sorted runs of a stream: a task holds one run.
    """
    keyed = distinct.select("fp", F.explode(variants(F.col("fp"), radius)).alias("key"))
    placed = keyed.repartition("key").sortWithinPartitions("key")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def close() -> None:
            if held and sum(map(len, held)) > 1:
                out.extend(_forest(np.concatenate(held), radius))

        def batch() -> pa.RecordBatch:
            a = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.uint64)
            b = np.concatenate([y for _, y in out]) if out else np.zeros(0, np.uint64)
            out.clear()
            pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in (0, 1)], ["a", "b"])

        forget()
        for rows in batches:
            fps = rows.column(0).to_numpy().view(np.uint64)
            keys = rows.column(1).to_numpy()
            if not len(keys):
                continue
            edge = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.r_[0, edge], np.r_[edge, len(keys)]
            if held_key is not None and keys[0] != held_key:
                close()
                held = []
            if held_key is not None and keys[0] == held_key and len(starts) > 1:
                held.append(fps[: ends[0]])
                close()
                held = []
                starts, ends = starts[1:], ends[1:]
            size = ends - starts
            inner = slice(0, -1)
            two = np.flatnonzero(size[inner] == 2)
            if len(two):
                a, b = fps[starts[two]], fps[starts[two] + 1]
                near = np.bitwise_count(a ^ b) <= radius
                out.append((np.minimum(a, b)[near], np.maximum(a, b)[near]))
            for k in np.flatnonzero(size[inner] > 2):
                out.extend(_forest(fps[starts[k] : ends[k]], radius))
            held.append(fps[starts[-1] : ends[-1]])
            held_key = keys[-1]
            if out:
                yield batch()
        close()
        yield batch()

    return placed.mapInArrow(edges, "a long, b long").distinct()


def roots_table(roots: DataFrame) -> DataFrame:
    """The table that what components() gave is read from."""
    return _stars[roots]


_stars: weakref.WeakKeyDictionary[DataFrame, DataFrame] = weakref.WeakKeyDictionary()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (a, b); root is the least node of its component.

    Alternates large-star and small-star steps until the edges are stars. Each round is written to
    the shared folder, which cuts the lineage; only a count and a checksum come to the driver.
    """
    current = written(edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)"))).first()
        return tuple(row)

    seen = mark(current)
    while seen[0]:
        both = current.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(current.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = salted_join(both.where("v > u"), least, "u", "v").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = salted_join(large, down, "hi", "lo").select(F.col("m"), "lo", "hi")
        step = small.select(F.col("m").alias("lo"), "hi").unionByName(small.select(F.col("m").alias("lo"), F.col("lo").alias("hi"))).where("lo <> hi").distinct()
        before, current = current, written(step, "stars")
        now = mark(current)
        discard(before)
        if now == seen:
            break
        seen = now
    out = current.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(current.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
    _stars[out] = current
    return out


def near_duplicates(df: DataFrame, identifier: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """identifier, fingerprint (16 hex digits) and component_id of every row of df.

    Rows whose fingerprints differ in at most radius bits are linked; component_id is the smallest
    identifier reachable over links. A null or blank text has fingerprint zero and links like any
    other; a row whose identifier is null keeps null there and takes part, its component_id is the
    smallest identifier that is not null (null if none is). Repeated rows are all returned. An empty
    table gives no rows; other columns are not read.

    Equal fingerprints are one node, so exact copies never meet each other as pairs.
    """
    name = free_name(df, "fp")
    marked = written(fingerprints(df.select(F.col(identifier).alias("id"), F.col(text).alias("text")), "text", name).select("id", F.col(name).alias("fp")), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    roots = components(links(nodes.select("fp"), radius))
    named = written(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", "n", "root"), "named")
    linked = named.where(F.col("root").isNotNull())
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = salted_join(linked, least, "root", "fp").select("fp", "n", "component_id")
    classes = classes.unionByName(named.where(F.col("root").isNull()).select("fp", "n", F.col("first").alias("component_id")))
    # A fingerprint that very many rows have meets them without a shuffle.
    total = marked.count()
    hot = F.col("n") > max(HOT_ROWS, total // HOT_SHARE)
    few = F.broadcast(classes.where(hot).drop("n"))
    told = marked.join(few, "fp").unionByName(marked.join(few.drop("component_id"), "fp", "left_anti").join(classes.where(~hot).drop("n"), "fp"))
    return told.select(
        F.col("id").alias(identifier),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_first(df: DataFrame, identifier: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """df without near-duplicates: of each component the row with the smallest identifier stays.

    Of rows with that same identifier the one with the smallest text hash stays, once; where no
    identifier of a component is known, one of its rows stays. All columns are kept as they are.
    """
    tag = free_name(df, "row_tag")
    tagged = written(df.withColumn(tag, F.monotonically_increasing_id()), "tagged")
    own = tagged.select(F.col(tag).alias("tag"), F.col(identifier).alias("id"), F.col(text).alias("text"))
    groups = fingerprints(own, "text", "fp").select("tag", "id", "fp")
    groups = written(groups, "fingerprints")
    nodes = groups.groupBy("fp").agg(F.min(F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("id"), "tag")).alias("first"))
    roots = components(links(nodes.select("fp"), radius))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(F.coalesce("root", "fp").alias("root"), "first")
    kept = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.tag").alias(tag))
    return tagged.join(kept, tag, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])


def _row(identifier: str, text: str, names: list[str] = _ROW) -> list[Column]:
    """The columns of _ROW, under some names; a null text is told from an empty one by its hash."""
    held = F.col(f"`{text}`")
    values = (F.coalesce(F.col(f"`{identifier}`").cast("long"), F.lit((1 << 63) - 1)), F.xxhash64(held), F.xxhash64(F.lit(1), held))
    return [v.alias(n) for v, n in zip(values, names)]


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of one text (UTF-8), words as in fingerprint_of(); none without a word."""
    import xxhash

    found = (text or b"").translate(_SQUEEZE).split()
    digest = xxhash.xxh64_intdigest
    if len(found) < size:
        return np.array([digest(b" ".join(found), 42)] if found else [], np.uint64)
    hashes = np.fromiter(map(digest, found), np.uint64, len(found))
    count = len(found) - size + 1
    out = np.zeros(count, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + count]
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    return np.unique(out ^ (out >> np.uint64(33)))


def _majority(hashes: np.ndarray) -> int:
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        total += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def _lists(of: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, of)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(of).view(np.int64) if of else np.zeros(0, np.int64)))


def shingle_sets(text: Column, size: int) -> Column:
    """shingle_set() of each whole text, as an array of longs."""

    @F.arrow_udf(ArrayType(LongType()))
    def sets(column: pa.Array) -> pa.Array:
        forget()
        return _lists([shingle_set(x.as_py(), size) for x in column.cast(pa.large_binary())])

    return sets(text)


def _sketch(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The parity of a set's hashes at each of so many places, a power of two; half of it folded onto the other is the next smaller one's."""
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<u8")


def sketches_apart(a: np.ndarray, b: np.ndarray) -> int:
    """In how many bits two sketches differ, the wider one folded; two sets differ in as many shingles at least."""
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


@F.arrow_udf(LongType())
def _wide_apart(one: pa.Array, other: pa.Array) -> pa.Array:
    """sketches_apart() of each row's two; 0 where one is null."""
    forget()
    out = np.zeros(len(one), np.int64)
    for k in np.flatnonzero(pc.and_(one.is_valid(), other.is_valid()).to_numpy(zero_copy_only=False)).tolist():
        out[k] = sketches_apart(*(x[k].values.to_numpy().view(np.uint64) for x in (one, other)))
    return pa.array(out)


def _signed(text: Column, size: int, similarity: float, common: dict[int, int]) -> Column:
    """node (a hash of the set of shingles), size, rare, fp, prefix, sketch and wide of each text.

    prefix has the set's first shingles in one order for all texts, rare (so many) before common ones: as many that
    two sets of that Jaccard similarity share one of them at least. wide is null for a small set.
    """
    names = np.array(sorted(common), np.uint64)
    ranks = np.array([common[k] for k in sorted(common)], np.int64)

    @F.arrow_udf(_SIGNED)
    def signed(column: pa.Array) -> pa.Array:
        import xxhash

        forget()

        nodes, sizes, rares, fps, prefixes, sketches, wides = [], [], [], [], [], [], []
        for x in column.cast(pa.large_binary()):
            own = shingle_set(x.as_py(), size)
            rank = np.zeros(len(own), np.int64)
            if len(names):
                at = np.minimum(np.searchsorted(names, own), len(names) - 1)
                rank = np.where(names[at] == own, ranks[at], 0)
            most = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1 if len(own) else 0
            nodes.append(xxhash.xxh64_intdigest(own.tobytes(), 42))
            sizes.append(len(own))
            fps.append(_majority(own))
            prefixes.append(own[np.lexsort((own, rank))[:most]])
            rares.append(int((rank == 0).sum()))
            sketches.append(_sketch(own, SKETCH_BITS))
            wides.append(_sketch(own, min(WIDE_BITS, 1 << (len(own) - 1).bit_length())).view(np.int64).tolist() if len(own) > SKETCH_BITS else None)
        longs = [pa.array(np.array(v, np.uint64).view(np.int64)) for v in (nodes, sizes, rares, fps)]
        return pa.StructArray.from_arrays([*longs, _lists(prefixes), _lists(sketches), pa.array(wides, pa.list_(pa.int64()))], _SIGNED.names)

    return signed(text)


def _common_shingles(texts: DataFrame, size: int) -> dict[int, int]:
    """Shingles of many texts and about their counts, from a sample of bounded size; they only order the prefixes.

    Repeats are counted within chunks of neighbouring texts, so single shingles are not shuffled.
    """
    share = min(1.0, SAMPLE_TEXTS / max(1, texts.count()))
    some = texts.where(F.pmod(F.xxhash64(*_ROW), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("text")

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0

        def counted() -> pa.RecordBatch:
            names, counts = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            many = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(names[many].view(np.int64)), pa.array(counts[many].astype(np.int64))], ["h", "n"])

        forget()
        for rows in batches:
            for x in rows.column(0).cast(pa.large_binary()):
                held.append(shingle_set(x.as_py(), size))
                total += len(held[-1])
                if total > CHUNK_SHINGLES:
                    yield counted()
                    held, total = [], 0
        yield counted()

    counts = some.mapInArrow(repeats, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_IN)
    with small_batches(texts.sparkSession):
        return {r["h"] & ((1 << 64) - 1): r["n"] for r in counts.orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()}


def _similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, similarity: float, repeated: bool) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles have at least that Jaccard similarity, a table.

    Pairs whose sketches differ in more bits than such sets can in shingles go first, by small sketches and
    then by those that are as wide as large sets need; the sets of the rest are compared.
    """
    x, y = ([F.col("node").alias(k), F.col("size").alias(f"size_{k}"), F.col("sketch").alias(f"sketch_{k}")] for k in "ab")
    told = pairs.distinct().join(nodes.select(*x), "a").join(nodes.select(*y), "b")
    apart = sum((F.bit_count(F.get("sketch_a", F.lit(k)).bitwiseXOR(F.get("sketch_b", F.lit(k)))) for k in range(SKETCH_BITS // 64)), F.lit(0))
    most = (F.col("size_a") + F.col("size_b")) * (1 - similarity) / (1 + similarity)
    first = written(told.where(apart <= most + 1e-6).select("a", "b", most.alias("most")), "first")
    x, y = ([F.col("node").alias(k), F.col("wide").alias(f"wide_{k}")] for k in "ab")
    wide = first.join(nodes.select(*x), "a").join(nodes.select(*y), "b").withColumn("apart", _wide_apart(F.col("wide_a"), F.col("wide_b")))
    near = written(wide.where("apart <= most + 1e-6").select("a", "b"), "pairs")
    discard(first)
    asked = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    wanted = nodes.join(asked, "node", "left_semi").select("node", *_ROW)
    sets = texts.join(wanted, _ROW).select("node", shingle_sets(F.col("text"), size).alias("own"))
    # Repeated rows, where there are any, give a node's set several times.
    sets = written(sets.dropDuplicates(["node"]) if repeated else sets, "sets")
    both = near.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    found = written(both.where(shared >= similarity * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b"), "similar")
    discard(near, sets)
    return found


def _most_partner(size: np.ndarray, pos: np.ndarray, similarity: float) -> np.ndarray:
    """The largest set that can be so similar to one of this size, if the first shingle that they share is this one's pos-th."""
    return (size - pos) * ((1 + similarity) / similarity) - size + 1e-6


def run_pairs(node: np.ndarray, root: np.ndarray, size: np.ndarray, pos: np.ndarray, part: np.ndarray, similarity: float, most: int = 1 << 18, sketch: np.ndarray | None = None, nearest: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes of one key that are of different roots and parts and can be so similar, by size, place and sketch (a row a node).

    Sizes rise. Members of the root with the most members only meet those of other roots, so what is
    looked at is a root's members times the others', within the sizes that may be similar, most at once.
    With nearest, of each member's pairs with larger roots only that of the least distance by sketch is given.
    """
    cap = _most_partner(size, pos, similarity)
    low, high = np.searchsorted(size, similarity * size - 1e-6), np.searchsorted(size, cap, "right")
    names, own, counts = np.unique(root, return_inverse=True, return_counts=True)
    rank = np.argsort(np.argsort(counts, kind="stable"), kind="stable")[own]
    looks = np.flatnonzero((rank < len(names) - 1) & (high > low))
    width = high[looks] - low[looks]
    edges = np.searchsorted(np.cumsum(width), np.arange(most, width.sum() + most, most))
    for some in np.split(looks, np.unique(np.minimum(edges + 1, len(looks)))[:-1] if len(edges) else []):
        x = np.repeat(some, high[some] - low[some])
        first = np.repeat(np.cumsum(high[some] - low[some]) - (high[some] - low[some]), high[some] - low[some])
        y = np.arange(len(x)) - first + low[x]
        kept = np.flatnonzero((rank[x] < rank[y]) & (cap[y] >= size[x]) & ((part[x] != part[y]) | (part[x] < 0)))
        x, y = x[kept], y[kept]
        if sketch is not None:
            apart = np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int64)
            kept = apart <= (size[x] + size[y]) * (1 - similarity) / (1 + similarity) + 1e-6
            x, y = x[kept], y[kept]
            if nearest:
                order = np.lexsort((apart[kept], x))
                x, y = x[order], y[order]
                one = np.r_[True, np.diff(x) != 0][: len(x)]
                x, y = x[one], y[one]
        if len(x):
            a, b = node[x], node[y]
            yield np.minimum(a, b), np.maximum(a, b)


def _pairs_between_roots(members: DataFrame, similarity: float, nearest: bool = False) -> DataFrame:
    """Candidate pairs (a, b) of members (key, root, node, size, pos, half: a sketch) that share a key; with nearest, one a member at most.

    Keys come as sorted runs of a stream. A key of over RUN members is dealt into parts, and each two parts meet in a
    task of their own, so that a task holds 2 * RUN members at most.
    """
    hot = members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > RUN).select("key", F.ceil(F.col("n") / RUN).cast("int").alias("parts"))
    placed = members.join(F.broadcast(hot), "key", "left")
    part = F.when(F.col("parts").isNull(), -1).otherwise(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cell = lambda j: F.greatest(F.col("part"), j) * F.lit(1 << 20) + F.least(F.col("part"), j)
    cells = F.when(F.col("part") < 0, F.array(F.lit(-1))).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), cell))
    sent = placed.withColumn("part", part).withColumn("cell", F.explode(cells.cast("array<long>")))
    # Within a cell of one part alone all members meet.
    sent = sent.withColumn("part", F.when(F.col("cell") % (1 << 20) == F.floor(F.col("cell") / (1 << 20)), -1).otherwise(F.col("part")))
    ordered = sent.select("key", "cell", "size", "node", "root", "pos", F.col("part").cast("int").alias("part"), "half").repartition("key", "cell").sortWithinPartitions("key", "cell", "size", "node")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[np.ndarray] = []
        out: list[np.ndarray] = []

        def told() -> pa.RecordBatch:
            """What has been found so far, a pair of several keys once."""
            found = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in (0, 1)], ["a", "b"])

        def closed(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                _, _, size, node, root, pos, part = rows[:, :7].T
                for a, b in run_pairs(node, root, size, pos, part, similarity, sketch=np.ascontiguousarray(rows[:, 7:]).view(np.uint64), nearest=nearest):
                    out.append(np.stack([a, b], 1))
                    if sum(map(len, out)) > PAIRS:
                        yield told()

        for batch in batches:
            if not len(batch):
                continue
            half = pc.list_flatten(batch.column(7)).to_numpy().reshape(len(batch), -1)
            rows = np.concatenate([np.stack([c.cast(pa.int64()).to_numpy() for c in batch.columns[:7]], 1), half], 1)
            edges = np.flatnonzero((np.diff(rows[:, :2], axis=0) != 0).any(1)) + 1
            for k, run in enumerate(np.split(rows, edges)):
                if held and (k or (held[-1][-1, :2] != run[0, :2]).any()):
                    yield from closed(np.concatenate(held))
                    held = []
                held.append(run)
        if held:
            yield from closed(np.concatenate(held))
        yield told()

    return ordered.mapInArrow(pairs, "a long, b long")


def similar_links(nodes: DataFrame, texts: DataFrame, size: int, similarity: float, radius: int = RADIUS, repeated: bool = True) -> DataFrame:
    """Links (a, b) between nodes that connect all that are linked by at least that similarity; each is verified.

    The first candidates are those of the deletion variants and, of each shared prefix shingle, its
    least node with every other. A large group of near copies falls into many components then, if they are not all like
    that one node; so of a crowded shingle's nodes each meets the nearest of another component, again and again
    (_merge_crowds()), which gives links in number like the nodes. At last all nodes of different components
    that share a prefix shingle are compared.
    """
    firsts = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    near = links(firsts.select("fp"), radius)
    near = near.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    near = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    # A common shingle's rows are dealt over several places, each with a lead of its own, and the leads meet the least of them.
    rows = nodes.select("node", "size", "rare", F.posexplode("prefix").alias("pos", "key"))
    rows = rows.select("node", "size", "pos", "key", F.when(F.col("pos") >= F.col("rare"), F.pmod(F.xxhash64("node"), F.lit(COMMON_SALTS)) + 1).otherwise(0).cast("int").alias("salt"))
    own = Window.partitionBy("key", "salt")
    rows = rows.select("*", F.count("*").over(own).alias("n"), F.min(F.struct("node", "size", "pos")).over(own).alias("lead"))
    shared = written(rows.where("n > 1 OR salt > 0"), "shared")

    def possible(x: str, y: str) -> Column:
        left = F.least(F.col(f"{x}.size") - F.col(f"{x}.pos"), F.col(f"{y}.size") - F.col(f"{y}.pos"))
        return left * (1 + similarity) >= similarity * (F.col(f"{x}.size") + F.col(f"{y}.size")) - 1e-6

    members = shared.select("lead", F.struct("node", "size", "pos").alias("m"))
    leads = shared.where("salt > 0").select("key", "lead").distinct()
    leads = leads.join(leads.groupBy("key").agg(F.min("lead").alias("least")), "key").select(F.col("least").alias("lead"), F.col("lead").alias("m"))
    led = members.unionByName(leads).where((F.col("lead.node") != F.col("m.node")) & possible("lead", "m")).select(F.col("lead.node").alias("a"), F.col("m.node").alias("b"))
    first = _similar(near.unionByName(led), nodes, texts, size, similarity, repeated)
    roots = components(first)
    # Pairs are told apart where they are made, by sketches of half the width, so that a hot key gives few.
    half = SKETCH_BITS // 128
    folded = F.zip_with(F.slice("sketch", 1, half), F.slice("sketch", half + 1, half), lambda x, y: x.bitwiseXOR(y))
    named = shared.where("n > 2 OR salt > 0").join(roots, "node", "left").join(nodes.select("node", folded.alias("half")), "node")
    named = written(named.select("key", F.coalesce("root", "node").alias("root"), "node", "size", "pos", "half"), "named")
    discard(shared, roots_table(roots))
    named, more = _merge_crowds(named, nodes, texts, size, similarity, repeated)
    last = _similar(_pairs_between_roots(named, similarity), nodes, texts, size, similarity, repeated)
    discard(named)
    parts = [first, *more, last]
    out = written(reduce(DataFrame.unionByName, parts), "links")
    discard(*parts)
    return out


def _merge_crowds(named: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, similarity: float, repeated: bool) -> tuple[DataFrame, list[DataFrame]]:
    """named (members of _pairs_between_roots(), a table) with the roots after links of near pairs in crowded keys, and tables of these links.

    Each round joins roots, as pairs lie between two; it ends when few pairs are links, and what is left is for all pairs to find.
    Links are among a round's roots, so components are made of roots, not of nodes.
    """
    found = []
    while True:
        crowds = named.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("one"), F.max("root").alias("other")).where((F.col("n") > CROWD) & (F.col("one") != F.col("other"))).select("key")
        tried = written(_pairs_between_roots(named.join(crowds, "key", "left_semi"), similarity, nearest=True).distinct(), "near")
        asked = tried.count()
        links = _similar(tried, nodes, texts, size, similarity, repeated) if asked else None
        discard(tried)
        if links is None:
            return named, found
        found.append(links)
        kept = links.count()
        if not kept:
            return named, found
        own = named.select("node", "root").distinct()
        between = links.join(own.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        merged = components(between.select(F.col("x").alias("a"), F.col("y").alias("b")))
        told = merged.select(F.col("node").alias("root"), F.col("root").alias("into"))
        before, named = named, written(named.join(told, "root", "left").select("key", F.coalesce("into", "root").alias("root"), "node", "size", "pos", "half"), "named")
        discard(before, roots_table(merged))
        if kept * WORTH < asked:
            return named, found


def keep_first_similar(df: DataFrame, identifier: str = "doc_id", text: str = "text", size: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """df without near-duplicates by similarity: of each component the row that keep_first() would keep stays.

    Rows are linked if the sets of their texts' shingles of size words have at least that Jaccard
    similarity; a text of fewer words is one shingle, and texts without a word are alike. No linked
    pair is lost: deletion variants of fingerprints find close copies, prefixes of the sets all others.
    """
    texts = df.select(*_row(identifier, text), F.col(text).alias("text"))
    signed = written(texts.select(*_ROW, _signed(F.col("text"), size, similarity, _common_shingles(texts, size)).alias("d")).select(*_ROW, "d.*"), "signed")
    rows = signed.groupBy("node", *_ROW).agg(F.count("*").alias("n"))
    firsts = written(rows.groupBy("node").agg(F.min(F.struct(*_ROW, "n")).alias("first")), "firsts")
    # Rows of one identifier and text have one set; one of them stands for the node.
    once = firsts.select("node", *[F.col(f"first.{c}").alias(c) for c in _ROW])
    repeated = not firsts.where("first.n > 1").isEmpty()
    nodes = signed.join(once, ["node", *_ROW], "left_semi")
    nodes = written(nodes.dropDuplicates(["node"]) if repeated else nodes, "nodes")
    discard(signed)
    edges = similar_links(nodes, texts, size, similarity, repeated=repeated)
    roots = components(edges)
    discard(nodes, edges)
    named = firsts.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    kept = written(named.groupBy("root").agg(F.min("first").alias("first")).select("first.*"), "kept")
    discard(firsts, roots_table(roots))
    names = [free_name(df, c) for c in _ROW]
    told = df.select(*[F.col(f"`{c}`") for c in df.columns], *_row(identifier, text, names))
    own = [F.col(f"`{c}`") for c in df.columns]
    renamed = kept.select(*[F.col(c).alias(n) for c, n in zip(_ROW, names)], "n")
    out = told.join(renamed.where("n = 1").drop("n"), names, "left_semi")
    if repeated:
        out = out.unionByName(told.join(renamed.where("n > 1").drop("n"), names, "left_semi").dropDuplicates(names))
    return out.select(*own)
