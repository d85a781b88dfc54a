"""Packing, manifest and vector codes against plain versions on small inputs with every odd row."""

import hashlib
import zlib

import numpy as np
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import merkle, packing, vector_codes
from millrace.llm.vector_codes import CoverTree

from .fixtures import BYTE_BPE, DOCS, SCHEMA, clashing, corpus, empty

BPE = tokenizers.Tokenizer.from_file(BYTE_BPE)


@pytest.fixture(scope="module", autouse=True)
def many_tasks(spark):
    """Small partitions are not put together, so that sources and lengths lie over several tasks."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def best_fit(lengths, capacity):
    """Remaining capacities after best-fit decreasing, piece by piece."""
    open_ = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, left in enumerate(open_) if left >= n]
        if fits:
            open_[min(fits, key=lambda k: open_[k])] -= n
        else:
            open_.append(capacity - n)
    return sorted(open_)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=150), st.integers(40, 64))
def test_plan_is_best_fit_decreasing(lengths, capacity):
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs = packing.plan(counts, capacity)
    filled, placed = {}, {}
    for k, (n, rank, first, offset, per) in enumerate(runs.tolist()):
        last = k + 1 == len(runs) or runs[k + 1][0] != n
        for past in range((counts[n] if last else runs[k + 1][1]) - rank):
            sequence, at = first + past // per, offset + past % per * n
            placed.setdefault(sequence, []).append((at, n))
            filled[sequence] = filled.get(sequence, 0) + n
        assert rank == 0 or runs[k - 1][0] == n
    assert sorted(capacity - v for v in filled.values()) == best_fit(lengths, capacity)
    for own in placed.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity


def test_tightest_is_the_least_that_fits():
    opened = packing.OpenSequences(50)
    some = np.random.default_rng(1).choice(np.arange(1, 51), 20, replace=False).tolist()
    for k, n in enumerate(some):
        opened.add(n, k, 1)
    for n in range(1, 51):
        assert opened.tightest(n) == min((x for x in some if x >= n), default=None)
    opened.take(max(some))
    assert opened.tightest(max(some)) is None


@pytest.mark.parametrize("source", [corpus, clashing])
def test_pieces_hold_all_ids_without_gaps(spark, source):
    packed = packing.pack_documents(source(spark), BYTE_BPE, capacity=64)
    rows = packed.collect()
    want = []
    for doc_id, text, *_ in DOCS:
        ids = [*BPE.encode(text or "", add_special_tokens=False).ids, 2]
        over = len(ids) % 64
        edges = [0, *range(over or 64, len(ids) + 1, 64)]
        want += [(doc_id, k, a, b - a, np.array(ids[a:b], "<u4").tobytes()) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in rows), key=key) == sorted(want, key=key)
    assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) for r in rows)
    assert len({r["sequence_id"] for r in rows}) == len(best_fit([w[3] for w in want], 64))
    for r in packing.sequences(packed).collect():
        own = sorted((x for x in rows if x["sequence_id"] == r["sequence_id"]), key=lambda x: x["offset"])
        assert bytes(r["ids"]) == b"".join(x["ids"] for x in own) and r["length"] == len(r["ids"]) // 4 <= 64
        assert [x["offset"] for x in own] == np.cumsum([0] + [x["length"] for x in own])[:-1].tolist()


def test_nothing_to_pack(spark):
    assert packing.pack_documents(empty(spark), BYTE_BPE).count() == 0
    assert packing.pack_documents(corpus(spark).where("doc_id = 4"), BYTE_BPE, end_id=None).count() == 0


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb_by_hand(leaves, positions):
    """The root of some leaves, and for each the siblings on its way."""
    ways, level = [[] for _ in leaves], list(leaves)
    at = list(positions)
    while len(level) > 1:
        runs = [level[k : k + 3] for k in range(0, len(level), 3)]
        for way, k in zip(ways, at):
            way.append((level[k - k % 3 : k], level[k + 1 : k - k % 3 + 3]))
        at = [k // 3 for k in at]
        level = [sha(*r) for r in runs]
    return level[0], ways


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def manifest_by_hand(docs):
    by = {}
    for doc_id, text, lang, source, n_chars in docs:
        leaf = sha(*map(field, (doc_id, source, lang, n_chars, text)))
        odd = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        given_ = sha(*map(field, (doc_id, source, lang, n_chars, text and text.replace("\n", "")))) if odd else leaf
        by.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, given_, doc_id))
    trees = []
    for source in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(by[source], key=lambda r: r[:3])
        trees.append((own, *climb_by_hand([r[2] for r in own], range(len(own)))))
    root, tops = climb_by_hand([t[1] for t in trees], range(len(trees)))
    out = []
    for (own, subroot, ways), top in zip(trees, tops):
        for (*_, leaf, given_, doc_id), way in zip(own, ways):
            found = given_
            for before, after in [*way, *top]:
                found = sha(*before, found, *after)
            proof = sha(*[x for before, after in [*way, *top] for x in (*before, *after)])
            out.append((doc_id, leaf, subroot, root, proof, found, found == root))
    return sorted(out, key=repr)


def verified(df):
    return sorted(map(tuple, merkle.verify(df, leaf=merkle.document_leaf(), other=merkle.tampered_leaf()).collect()), key=repr)


MORE = [(k, f"text {k}\nof {k % 7}", "en", "big", k) for k in range(100, 223)] + [(5, "one\n", None, "é", 1), (300, "x\n", "en", "Z", None)]


def test_manifest_by_hand(spark):
    docs = DOCS + MORE
    got = verified(spark.createDataFrame(docs, SCHEMA).repartition(5))
    assert got == manifest_by_hand(docs)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("docs", [DOCS[:1], [d for d in MORE if d[3] == "big"][:3], [(1, None, None, None, None)] * 4, []])
def test_manifest_of_few_rows(spark, docs):
    assert verified(spark.createDataFrame(docs, SCHEMA)) == (manifest_by_hand(docs) if docs else [])


def test_manifest_beyond_broadcast_and_with_other_columns(spark, monkeypatch):
    monkeypatch.setattr(merkle, "MOST_SOURCES", 1)
    names = "tree place serial hash n run tie task before up_tree leaf root".split()
    got = verified(corpus(spark).withColumns({n: F.lit("mine") for n in names}))
    assert got == manifest_by_hand(DOCS)
    limit = "spark.sql.cteRecursionRowLimit"
    assert spark.conf.get(limit, None) != "-1"


points = st.lists(st.tuples(*[st.integers(-9, 9)] * 3), min_size=1, max_size=80)


@settings(max_examples=150, deadline=None)
@given(points, points)
def test_trees_give_the_nearest_entry(some, entries):
    rows, entries = np.array(some), np.array(entries[:6])
    tree, node = CoverTree.build(rows)
    assert (tree.points[node] == rows).all() and tree.total[-1] == len(rows)
    for k in range(len(tree.points)):
        inside = tree.points[k : tree.ends[k]]
        assert np.sqrt(((inside - tree.points[k]) ** 2).sum(1)).max() <= tree.radius[k] + 1e-9
    entry = np.full(len(tree.points), -1)
    for first, end, own in tree.nearest(entries):
        for a, b, e in zip(first, end, own):
            assert (entry[a:b] == -1).all()
            entry[a:b] = e
    assert (entry[node] == ((rows[:, None] - entries[None]) ** 2).sum(2).argmin(1)).all()


def test_far_groups_are_given_whole():
    """Nodes compared are few where groups lie apart."""
    rng = np.random.default_rng(0)
    entries = rng.integers(-100_000, 100_000, (16, 8))
    rows = np.concatenate([e + rng.integers(-20, 20, (500, 8)) for e in entries])
    tree, _ = CoverTree.build(rows)
    compared = sum(len(first) for first, _, _ in tree.nearest(entries))
    assert compared < len(rows) / 20


def lloyd(rows, parts, entries, rounds):
    """Codes and errors by id, and the codebooks; rows are (id, label, vector) that are kept."""
    v = {i: [int(np.floor(4096 * float(np.float32(x)))) for x in vec] for i, _, vec in rows}
    width = len(next(iter(v.values()))) // parts
    cut = lambda x, p: x[p * width : (p + 1) * width]
    books = [[cut(v[i], p) for i in sorted(v)[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for x in v.values():
                own.setdefault(near(cut(x, p), books[p])[1], []).append(cut(x, p))
            for k, xs in own.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    found = {i: [near(cut(x, p), books[p]) for p in range(parts)] for i, x in v.items()}
    flat = ",".join(str(x) for book in books for e in book for x in e)
    return {i: ("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for i, f in found.items()}, hashlib.sha256(flat.encode()).hexdigest()


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("count", [3, 70])
def test_codes_by_hand(spark, count):
    rng = np.random.default_rng(count)
    centres = rng.normal(0, 1, (4, 16))
    rows = [(k * 3 % 211, k % 3 if k % 5 else None, (centres[k % 4] + rng.normal(0, 0.2, 16)).astype("f4").tolist()) for k in range(count)]
    rows += [(500 + k, 1, rows[0][2]) for k in range(20)]
    odd = [(900, None, 1), (901, [0.5] * 15 + [None], 1), (902, [float("nan")] * 16, 2), (903, [float("inf")] + [0.0] * 15, 2)]
    df = spark.createDataFrame([(i, v, lab) for i, lab, v in rows] + odd, VECTORS).repartition(3)
    want, digest = lloyd(rows, 8, 16, 6)
    got = vector_codes.compress(df.withColumns({n: F.lit(1) for n in ("v", "id", "key", "code", "salt")})).collect()
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want and len(got) == len(rows)
    labels = {i: lab for i, lab, _ in rows}
    for r in got:
        assert r["label_error"] == sum(e for i, (_, e) in want.items() if labels[i] == labels[r["vec_id"]])
        assert r["codebooks_sha256"] == digest


def test_odd_vectors(spark):
    rows = [(1, [0.5] * 8, None), (1, [0.25] * 8, None), (None, [0.5] * 8, 1), (2, [1.0] * 9, 1), (3, [1e30] * 8, 1), (4, [], 2)]
    got = vector_codes.compress(spark.createDataFrame(rows, VECTORS)).collect()
    told = sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=repr)
    assert told == sorted([(1, "00" * 8, 0, 0), (1, "01" * 8, 0, 0), (None, "01" * 8, 0, 0), (2, None, None, 0), (3, None, None, 0), (4, None, None, None)], key=repr)
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1)], VECTORS)).count() == 0


def test_labels_beyond_broadcast_and_decoding(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "MOST_LABELS", 1)
    rows = [(k, [k % 4 + 0.125] * 8, k % 3 or None) for k in range(40)]
    got = vector_codes.compress(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == 40 and all(r["error"] == r["label_error"] == 0 for r in got)
    vectors = spark.createDataFrame(rows, VECTORS).select(F.col("vec_id").alias("id"), "label", vector_codes.scaled(F.col("embedding")).alias("v"))
    chunks, books = vector_codes.train(vectors)
    for r in vector_codes.assigned(chunks, books).select("id", vector_codes.decoded(F.col("code"), books).alias("x")).collect():
        assert np.abs(np.array(r["x"]) - (r["id"] % 4 + 0.125)).max() < 1 / 4096


def test_the_climb_has_a_row_a_run_of_leaves(spark, monkeypatch):
    """What a leaf's step moved grew with leaves times levels; a run of leaves has one way above it."""
    rows, write = {}, merkle.written

    def counted(df, label, **options):
        out = write(df, label, **options)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(merkle, "written", counted)
    docs = [(k, f"text\n{k}", "en", "ab"[k % 2], k) for k in range(1600)]
    assert verified(spark.createDataFrame(docs, SCHEMA)) == manifest_by_hand(docs)
    assert rows["bottom"] == 1600 and rows["climbed"] == 2 * -(-800 // 27)
