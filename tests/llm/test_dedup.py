"""SimHash components, substring repeats and decontamination against brute force."""

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from millrace.llm import decontaminate, simhash_dedup, substring_dedup

from .fixtures import DOCS, clashing, corpus, empty, prose


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(fps, radius=4):
    """The least index of each one's component."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_components(spark):
    got = simhash_dedup.near_duplicates(clashing(spark)).collect()
    fps = [fingerprint(t) for _, t, *_ in DOCS]
    groups = collections.defaultdict(list)
    root = roots(fps)
    for r, d in zip(root, DOCS):
        groups[r].append(d[0])
    want = [(d[0], f"{f:016x}", min((x for x in groups[r] if x is not None), default=None)) for d, f, r in zip(DOCS, fps, root)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert simhash_dedup.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("radius", [2, 4, 7])
def test_no_link_is_lost(spark, radius):
    """Random fingerprints, chains and a large ball of near ones, linked as brute force links them."""
    rng = np.random.default_rng(radius)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for _ in range(3):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(12):  # a chain whose ends are far apart
            for b in rng.choice(63, radius, replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    centre = int(rng.integers(0, 1 << 63))
    for _ in range(150):
        y = centre
        for b in rng.choice(63, max(1, radius // 2), replace=False):
            y ^= 1 << int(b)
        fps.append(y)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(3)
    edges = simhash_dedup.links(df, radius)
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= radius for r in edges.collect())
    found = {r["node"]: r["root"] for r in simhash_dedup.components(edges).collect()}
    root = roots(fps, radius)
    assert [found.get(x, x) for x in fps] == [fps[k] for k in root]
    assert edges.count() <= 64 * len(fps)


def test_one_of_each_group_stays(spark):
    kept = simhash_dedup.keep_first(clashing(spark))
    assert kept.columns == clashing(spark).columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    fps = [fingerprint(t) for _, t, *_ in DOCS]
    assert len(ids) == len(set(roots(fps))) and ids.count("6") == 0 and "0" in ids
    assert simhash_dedup.keep_first(empty(spark)).count() == 0


def removed(docs, window):
    """doc_id, n_words, n_removed and sha256 of the kept words by plain loops."""
    first = {}
    for d, t, *_ in docs:
        w = words(t)
        for k in range(len(w) - window + 1) if d is not None else ():
            key = tuple(w[k : k + window])
            first[key] = min(d, first.get(key, d))
    out = []
    for d, t, *_ in docs:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[k : k + window])] < d:
                gone[k : k + window] = [True] * window
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [13, 4, 7])
def test_repeats(spark, window):
    got = substring_dedup.repeats(clashing(spark), window=window, group_bytes=2000).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256), "spans").collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted(removed(DOCS, window), key=str)
    assert all(sum(s["last"] - s["first"] + 1 for s in r["spans"]) == r["n_removed"] for r in got)
    assert substring_dedup.repeats(empty(spark)).count() == 0


def test_repeats_on_many_small_documents(spark):
    """Shared passages at odd offsets, in random pieces."""
    rng = np.random.default_rng(3)
    pool = [prose(k, 40).split() for k in range(6)]
    docs = []
    for d in range(80):
        w = []
        for _ in range(rng.integers(0, 4)):
            p = pool[rng.integers(6)]
            a = int(rng.integers(0, 20))
            w += p[a : a + int(rng.integers(5, 25))] + [f"own{d}"]
        docs.append((int(d) if d % 9 else 3, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = substring_dedup.repeats(df, group_bytes=500).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(removed(docs, 13))
    assert sum(r["n_removed"] for r in got) > 100


def test_packing():
    for v in ([], [0], [5, 5, 900], [1, 1 << 40, (1 << 64) - 1]):
        a = np.array(v, np.uint64)
        assert substring_dedup.unpack_sorted(substring_dedup.pack_sorted(a)).tolist() == v


def test_windows_with_equal_hashes_are_told_apart(spark, monkeypatch):
    """Nearly all first hashes collide: only the other 64 bits tell windows apart."""
    docs = [(k, prose(70 + k % 7, 20) + " " + prose(80 + k % 11, 20)) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)

    def got():
        return sorted(map(tuple, substring_dedup.repeats(df).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()))

    own = substring_dedup._Group.rolling
    monkeypatch.setattr(substring_dedup._Group, "rolling", lambda self, size, places, words=None: own(self, size, places, words) & np.uint64((1 << 64) - 1 if words is not None else 3 << 62))
    group = substring_dedup._Group(pa.table({"id": [k for k, _ in docs], "text": [t for _, t in docs], "copies": [1] * len(docs)}), 13)
    _, keys, _, of, _ = group.windows(np.ones(len(group.hash), bool))
    assert len(set(keys.tolist())) <= 4 < len(keys) == len({tuple(w[k : k + 13]) for _, t in docs for w in [t.split()] for k in range(len(w) - 12)})
    assert got() == sorted(removed(docs, 13))


def test_very_many_repeated_rows(spark):
    """100,000 equal rows beside others: all come back, and none loses to its own copies."""
    text = prose(40, 30)
    docs = spark.createDataFrame([(1, text), (2, "so " + text), (3, prose(41, 20))], "doc_id long, text string")
    df = docs.unionByName(spark.range(100_000).select(F.lit(2).cast("long").alias("doc_id"), F.lit("so " + text).alias("text")))
    got = substring_dedup.repeats(df).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert {tuple(r) for r in got} == {(1, 30, 0, 1), (2, 31, 30, 100_001), (3, 20, 0, 1)}


def test_large_buckets_lose_no_link():
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    flips = [np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, 2).astype(np.uint64)) for _ in range(4000)]
    members = np.unique(np.concatenate([base, base[rng.integers(0, 1500, 4000)] ^ np.array(flips, np.uint64)]))

    def classes(edges):
        root = {int(x): int(x) for x in members}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            for x, y in zip(a.tolist(), b.tolist()):
                assert (x ^ y).bit_count() <= 4
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
        return [find(int(x)) for x in members]

    every = [(members[k : k + 1].repeat(int(near.sum())), members[near]) for k in range(len(members)) if (near := np.bitwise_count(members ^ members[k]) <= 4).any()]
    assert len(members) > simhash_dedup.BUCKET and classes(simhash_dedup._forest(members, 4)) == classes(every)


ITEMS = [(0, prose(50, 40)), (1, prose(51, 25).upper() + "!"), (2, None), (3, "four words are few"), (4, prose(50, 40)), (5, prose(52, 70))]


def leaks(docs, items):
    def shingles(t):
        w = regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
        return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]

    out = {}
    for i, t in items:
        own = collections.Counter(shingles(t))
        n = sum(own.values())
        for d, text, *_ in docs if n else ():
            s = shingles(text)
            best = 0
            for a in range(max(1, len(s) - n + 1)):
                w = s[a : a + n]
                m = sum((own & collections.Counter(w)).values())
                best = max(best, m / (n + len(w) - m)) if w else best
            if best >= 0.8:
                out[d, i] = max(round(best, 9), out.get((d, i), 0))
    return out


def test_leaks(spark):
    w = prose(52, 70).split()
    planted = [
        (100, prose(60, 50) + " " + prose(50, 40).title() + ", " + prose(61, 50)),
        (101, " ".join(w[:30] + ["new"] + w[30:])),
        (102, " ".join(w[:64])),
        (103, " ".join(w[:20] + ["x", "y", "z"] + w[20:40] + ["u", "v"] + w[40:])),
        (104, prose(51, 25).replace(" ", "\n- ")),
        (105, prose(50, 40) + " " + prose(50, 40)),
        (106, " ".join(prose(50, 40).split()[:12])),
    ]
    docs = [*((d[0], d[1]) for d in DOCS), *planted]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("size", F.lit("mine"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontaminate.matches(df, items).collect()}
    assert got == leaks(docs, ITEMS) and {100, 101, 102, 104, 105} <= {d for d, _ in got} and not {103, 106} & {d for d, _ in got}
    clean = decontaminate.clean(df, items)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in got} and clean.columns == df.columns
    assert decontaminate.matches(empty(spark), items).count() == 0
    assert decontaminate.matches(df, items.limit(0)).count() == 0


def test_leaks_without_broadcast(spark, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = corpus(spark).select("doc_id", "text").union(spark.createDataFrame([(100, "so " + prose(50, 40))], "doc_id long, text string"))
    small = sorted(map(tuple, decontaminate.matches(df, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, decontaminate.matches(df, items).collect())) == small and small


def test_leaks_of_very_long_items(spark):
    """An item of 70,000 words, one of a single repeated word, and copies of them inside documents."""
    words = [f"w{k * 7919 % 50021}" for k in range(70_000)]
    items = spark.createDataFrame([(0, " ".join(words)), (1, "again " * 70_000), (2, prose(50, 40)), (3, "once more " * 20)], "item_id long, text string")
    docs = [(0, " ".join(words)), (1, " ".join(words[:40_000] + ["x"] * 40 + words[40_040:])), (2, " ".join(words[:50_000])), (3, "again " * 69_000), (4, prose(50, 40)), (5, "once more " * 30), (6, prose(51, 40))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.matches(df, items).collect()}
    n = 69_996
    changed = 44 / n
    assert set(got) == {(0, 0), (1, 0), (3, 1), (4, 2), (5, 3)}
    assert got[0, 0] == got[4, 2] == got[5, 3] == 1 and got[1, 0] == pytest.approx((1 - changed) / (1 + changed)) and got[3, 1] == pytest.approx(68_996 / n)


def test_shared_weight_and_candidates(spark):
    rng = np.random.default_rng(9)
    rows = [([int(x) for x in rng.integers(0, 6, n)], [int(x) for x in rng.integers(0, 6, m)]) for n, m in ((1, 1), (5, 9), (40, 40), (300, 20))]
    got = [r[0] for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a array<long>, b array<long>").orderBy("k").select(decontaminate.shared_weight(F.col("a"), F.col("b"))).collect()]
    assert got == [sum((collections.Counter(a) & collections.Counter(b)).values()) for a, b in rows]


def test_simhash_in_sql_equals_plain_counting(spark):
    rng = np.random.default_rng(5)
    arrays = [[int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, n)] for n in (1, 2, 3, 36, 700, 40_000)]
    got = spark.createDataFrame([(k, a) for k, a in enumerate(arrays)], "k int, w array<long>").select("k", decontaminate.fingerprint(F.col("w")).alias("f")).orderBy("k").collect()
    for a, r in zip(arrays, got):
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in a) > len(a))
        assert r["f"] & (1 << 64) - 1 == want


def test_similar_texts_against_brute_force(spark):
    """Every pair of similarity 0.8 or more is linked, close or at the limit, and no other."""
    rng = np.random.default_rng(3)
    texts = []
    for k in range(60):
        base = [f"w{x}" for x in rng.integers(0, 4000, int(rng.integers(6, 200)))]
        texts.append(base)
        for _ in range(int(rng.integers(0, 5))):
            copy = list(base)
            for at in rng.integers(0, len(copy), int(rng.integers(1, 2 + len(copy) // 25))):
                copy[at] = f"x{rng.integers(0, 10**6)}"
            texts.append(copy)
    passage = [f"p{x}" for x in range(40)]
    texts += [passage + [f"q{k}_{x}" for x in range(60)] for k in range(30)]
    texts += [passage + [f"r{k}_{x}" for x in range(2)] for k in range(30)] + [["one", "two"], ["One", "two"], ["one"], [], []]
    sets = [{tuple(w.lower() for w in t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set() for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    far = 0
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] | sets[b])
            if not both or len(sets[a] & sets[b]) / both >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
                fps = [simhash_dedup._majority(simhash_dedup.shingle_set(" ".join(texts[k]).encode(), 5)) for k in (a, b)]
                far += (fps[0] ^ fps[1]).bit_count() > 4
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    kept = {r["doc_id"] for r in simhash_dedup.keep_first_similar(df).collect()}
    assert far > 20 and kept == {k for k in root if find(k) == k}


def test_documents_that_share_one_passage_give_no_candidates(spark):
    """Pairs of a hot shingle whose sets can't be similar are never made, so candidates grow with the documents, not with their pairs."""
    found = []
    for n in (2000, 4000):
        passage = [f"p{x}" for x in range(40)]
        texts = [(k, " ".join([*passage, *(f"q{k}_{x}" for x in range(8))])) for k in range(n)]
        sets = [simhash_dedup.shingle_set(t.encode(), 5) for _, t in texts[:50]]
        both = len(np.intersect1d(sets[0], sets[1]))
        assert both / (len(sets[0]) + len(sets[1]) - both) < 0.8
        # One key that all have, as the last rare place of their prefixes.
        size = np.full(n, len(sets[0]))
        pairs = list(simhash_dedup.run_pairs(np.arange(n), np.arange(n), size, np.full(n, 8), np.full(n, -1), 0.8))
        found.append(sum(len(a) for a, _ in pairs))
    assert found == [0, 0]


def test_sketches_of_a_run_lose_no_similar_pair():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[k:], rng.integers(0, 1 << 63, k).astype(np.uint64)])) for k in range(0, 120, 4)] + [rng.integers(0, 1 << 63, 400).astype(np.uint64) for _ in range(20)]
    sketch = np.stack([simhash_dedup._sketch(x, 512) for x in sets])
    n, size = len(sets), np.full(len(sets), 400)
    got = {(int(x), int(y)) for a, b in simhash_dedup.run_pairs(np.arange(n), np.arange(n), size, np.zeros(n), np.full(n, -1), 0.8, sketch=sketch) for x, y in zip(a, b)}
    shared = {(i, j): len(np.intersect1d(sets[i], sets[j])) for j in range(n) for i in range(j)}
    alike = {p for p, k in shared.items() if k >= 0.8 * (800 - k)}
    assert alike <= got and len(got) < len(alike) * 1.5 and not any(i >= 30 or j >= 30 for i, j in got)


@pytest.mark.parametrize("most", [7, 1 << 20])
def test_candidates_of_a_run(most):
    """All pairs of other roots and parts that can be so similar, each once, whatever is looked at at once."""
    rng = np.random.default_rng(5)
    n = 60
    size = np.sort(rng.integers(5, 40, n))
    pos = (size * rng.random(n) * 0.25).astype(int)
    node, root, part = rng.permutation(n), rng.integers(0, 6, n), rng.integers(0, 3, n)
    for parts in (part, np.full(n, -1)):
        got = [(int(x), int(y)) for a, b in simhash_dedup.run_pairs(node, root, size, pos, parts, 0.8, most) for x, y in zip(a, b)]
        left = lambda i, j: min(size[i] - pos[i], size[j] - pos[j])
        want = {(min(node[i], node[j]), max(node[i], node[j])) for i in range(n) for j in range(i) if root[i] != root[j] and (parts[i] != parts[j] or parts[i] < 0) and left(i, j) * 1.8 >= 0.8 * (size[i] + size[j]) - 1e-7}
        assert len(got) == len(set(got)) and set(got) == want


def test_similar_texts_with_split_runs(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "RUN", 3)
    test_similar_texts_against_brute_force(spark)


def test_wide_sketches_fold_and_never_exceed_the_sets_difference():
    rng = np.random.default_rng(8)
    for n, m, both in ((3000, 2500, 1000), (1500, 6000, 1400), (40, 40, 0)):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[:both], rng.integers(0, 1 << 63, m - both).astype(np.uint64)])
        wide = [simhash_dedup._sketch(x, min(simhash_dedup.WIDE_BITS, 1 << (len(x) - 1).bit_length())) for x in (a, b)]
        small = simhash_dedup._sketch(a, 64 * min(map(len, wide)))
        assert simhash_dedup.sketches_apart(wide[0], small) == 0
        apart = simhash_dedup.sketches_apart(*wide)
        assert apart <= len(np.setxor1d(a, b)) and apart > 0.2 * (n + m - 2 * both)


def test_nearest_of_a_run_is_one_pair_a_member_at_most():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[k:], rng.integers(0, 1 << 63, k).astype(np.uint64)])) for k in rng.integers(0, 30, 80).tolist()]
    sketch, n, size = np.stack([simhash_dedup._sketch(x, 512) for x in sets]), len(sets), np.full(len(sets), 200)
    root = rng.integers(0, 20, n)
    runs = [[(int(x), int(y)) for a, b in simhash_dedup.run_pairs(np.arange(n), root, size, np.zeros(n), np.full(n, -1), 0.8, 50, sketch, nearest) for x, y in zip(a, b)] for nearest in (False, True)]
    apart = lambda p: simhash_dedup.sketches_apart(sketch[p[0]], sketch[p[1]])
    larger = np.argsort(np.argsort(np.bincount(root, minlength=20)[np.unique(root)], kind="stable"), kind="stable")[np.unique(root, return_inverse=True)[1]]
    want = {}
    for x, y in runs[0]:
        small = x if larger[x] < larger[y] else y
        want[small] = min(want.get(small, 999), apart((x, y)))
    assert set(runs[1]) <= set(runs[0]) and sorted(map(apart, runs[1])) == sorted(want.values()) and len(runs[0]) > 5 * n


def test_a_crowd_of_near_copies_gives_few_pairs(spark, monkeypatch):
    """400 copies, half of the pairs similar: without rounds of nearest ones the pairs grow with the square; components are those of all pairs."""
    rng = np.random.default_rng(12)
    base = [f"w{x}" for x in range(150)]
    texts = []
    for k in range(400):
        copy = list(base)
        for at in rng.integers(0, 150, int(rng.integers(1, 5))):
            copy[at] = f"x{k}_{at}"
        texts.append(copy)
    sets = [{tuple(t[i : i + 5]) for i in range(146)} for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                root[max(find(a), find(b))] = min(find(a), find(b))
    made, pairs = [], simhash_dedup._pairs_between_roots

    def counted(*args, **options):
        out = pairs(*args, **options)
        made.append(out.count())
        return out

    monkeypatch.setattr(simhash_dedup, "_pairs_between_roots", counted)
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash_dedup.keep_first_similar(df).collect()}
    assert kept == {find(k) for k in range(len(texts))}
    assert sum(made) < 10 * len(texts), made
