"""Versioned tables: merges against plain dictionaries, snapshots, conflicts, failed writes."""

import pytest
from pyspark.sql import functions as F

from millrace.sources.versioned import Conflict, VersionedTable

KIND = "k long, name string, n int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def held(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.create(spark.createDataFrame([(k, f"r{k}", k) for k in range(20)] + [(None, "none", -1)], KIND), ["k"], 4)
    return t


def test_merge_against_a_dictionary(spark, held):
    source = [(k, f"s{k}", None if k % 4 else -k) for k in range(15, 30)] + [(None, "again", 5)]
    held.merge(spark.createDataFrame(source, KIND), delete=F.col("s.k") % 5 == 0)
    want = {k: (k, f"r{k}", k) for k in range(20)} | {k: (k, n, x) for k, n, x in source if k is not None}
    want = [v for k, v in want.items() if not (k >= 15 and k % 5 == 0)] + [(None, "none", -1), (None, "again", 5)]
    assert rows(held.read()) == sorted(want, key=repr)
    assert held.read(1).count() == 21 and [(r[0], r[1], r[2]) for r in held.history().collect()] == [(1, "create", 21), (2, "merge", len(want))]


def test_values_of_a_merge(spark, held):
    source = spark.createDataFrame([(1, 10), (2, 20), (99, 5)], "k long, add int")
    held.merge(source, update={"n": F.col("t.n") + F.col("s.add")}, insert=False)
    assert [r["n"] for r in held.read().where("k IN (1, 2, 99)").orderBy("k").collect()] == [11, 22]
    held.merge(source, update=False)
    assert [tuple(r) for r in held.read().where("k = 99 OR k = 1").orderBy("k").collect()] == [(1, "r1", 11), (99, None, None)]


def test_several_rows_with_one_key(spark, held):
    source = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], KIND)
    with pytest.raises(ValueError, match="several rows"):
        held.merge(source)
    assert held.numbers() == [1]
    held.merge(source, newest="n")
    assert held.read().where("k = 1").first()["name"] == "new"
    with pytest.raises(ValueError, match="several rows"):
        held.merge(source.withColumn("n", F.lit(1)), newest="n")
    with pytest.raises(ValueError, match="key can't"):
        held.update({"k": F.lit(1)}, F.lit(True))


def test_only_changed_buckets_are_written(spark, held):
    before = held.version().held
    v = held.merge(spark.createDataFrame([(3, "x", 0)], KIND))
    assert len(v.changed) == 1 and all(v.held[b] == x for b, x in before.items() if b not in v.changed)
    files = held.read().inputFiles()
    assert {f.split("bucket_number=")[1].split("/")[0] for f in files} == {str(b) for b in v.held}
    assert held.merge(spark.createDataFrame([], KIND)).number == 2


def test_readers_keep_their_snapshot_and_failed_writes_change_nothing(spark, held):
    old = held.read()
    first = rows(old)
    held.delete(F.col("k") > 10)
    assert rows(old) == first and held.read().count() == 12
    bad = spark.createDataFrame([(1, "x", 1)], KIND).withColumn("name", F.when(F.col("k") > 0, F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        held.merge(bad)
    assert held.numbers() == [1, 2] and held.read().count() == 12
    held.restore(1)
    assert rows(held.read()) == first
    assert held.delete(F.col("n") > 1000).number == 3


def test_of_two_writers_one_commits(spark, held):
    """A writer that began before another's commit: with other buckets it follows, with the same ones it fails."""
    one, two = (VersionedTable(spark, held.path) for _ in range(2))
    by = {}
    for r in held.read().where("k IS NOT NULL").select("k", F.pmod(F.xxhash64("k"), F.lit(4)).alias("b")).collect():
        by.setdefault(r["b"], []).append(r["k"])
    first, *others = sorted(by)

    def meanwhile(k):
        two.update({"name": F.lit("two")}, F.col("k") == k)

    def racing(k, other):
        base = one.version()
        one._base = lambda: (meanwhile(other), base)[1]
        try:
            return one.update({"name": F.lit("one")}, F.col("k") == k)
        finally:
            del one._base

    a, b = by[first][0], by[others[0]][0]
    racing(a, b)
    assert {r["k"]: r["name"] for r in held.read().where(F.col("k").isin(a, b)).collect()} == {a: "one", b: "two"}
    before = held.numbers()
    with pytest.raises(Conflict):
        racing(a, by[first][-1])
    assert len(held.numbers()) == len(before) + 1 and held.read().count() == 21


def test_vacuum_and_overwrite(spark, held):
    held.overwrite(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], KIND))
    held.merge(spark.createDataFrame([(2, "c", 3)], KIND))
    want = rows(held.read())
    assert held.vacuum() > 0 and held.numbers() == [3] and rows(held.read()) == want
    assert held.vacuum() == 0
    held.overwrite(spark.createDataFrame([], KIND))
    assert held.read().count() == 0
    with pytest.raises(ValueError, match="no version 1"):
        held.read(1)
