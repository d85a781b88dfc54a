"""As-of and range joins and windows over large groups, against plain versions."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import asof, ordered, ranges

ROWS = [(k % 3 if k % 7 else None, (k * 37) % 50 if k % 11 else None, k) for k in range(300)]
HOT = [(1, k % 40, 1000 + k) for k in range(400)]


@pytest.fixture(scope="module", autouse=True)
def many_tasks(spark):
    """Small partitions are not put together, so that groups lie over several tasks."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def bag(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(ROWS + HOT, "g long, t long, v long").repartition(5)


def test_running_values(spark, data):
    order = [F.asc_nulls_first("t"), F.asc("v")]
    got = ordered.running_totals(data, ["g"], order, s=("sum", F.when(F.col("v") % 2 == 0, F.col("v"))), n=("count", F.lit(1)), low=("min", F.col("v")), last=("last", F.when(F.col("v") % 5 == 0, F.col("v"))))
    w = Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    even, fifth = F.when(F.col("v") % 2 == 0, F.col("v")), F.when(F.col("v") % 5 == 0, F.col("v"))
    want = data.withColumns({"s": F.sum(even).over(w), "n": F.count(F.lit(1)).over(w), "low": F.min("v").over(w), "last": F.last(fifth, ignorenulls=True).over(w)})
    assert bag(got) == bag(want)


def test_a_global_window_has_no_large_task(spark, data):
    """One group lies over all partitions, evenly, and what is carried is a row a task at most."""
    d = ordered.dealt(data, [], [F.asc("t"), F.asc("v")])
    sizes = [r["count"] for r in d.df.groupBy(d.task).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 2.5 * data.count() / len(sizes)
    plan = ordered.running(d, d.df, [], s=("sum", F.col("v")))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastNestedLoopJoin" in plan


def test_ranks_with_ties_over_tasks(spark, data):
    got = ordered.ranked(data, ["g"], [F.desc_nulls_last("t")], ["t"]).drop("place")
    w = Window.partitionBy("g").orderBy(F.desc_nulls_last("t"))
    assert bag(got) == bag(data.withColumns({"rank": F.rank().over(w).cast("long"), "dense_rank": F.dense_rank().over(w).cast("long")}))


@pytest.mark.parametrize("block", [7, 100])
def test_frames_over_blocks(spark, data, block):
    order = [F.asc_nulls_first("t"), F.asc("v")]
    asked = {"a": lambda w: F.sum("v").over(w.rowsBetween(-3, 2)), "b": lambda w: F.lag("v", 4).over(w), "c": lambda w: F.max("v").over(w.rowsBetween(-5, -1))}
    got = ordered.framed(data, ["g"], order, 5, 2, block, **asked)
    w = Window.partitionBy("g").orderBy(*order)
    assert bag(got) == bag(data.withColumns({n: f(w) for n, f in asked.items()}))


def test_nothing_in_order(spark, data):
    none = data.where("false")
    assert ordered.running_totals(none, ["g"], [F.asc("t")], s=("sum", F.col("v"))).count() == 0
    assert ordered.framed(none, [], [F.asc("t")], 1, 1, a=lambda w: F.lag("v").over(w)).count() == 0


def found_by_hand(left, right, backward, strict, most=None):
    """Of each row of left the row of right that an as-of join gives it."""
    out = []
    for row in left:
        key, t = row[:2]
        fits = [r for r in right if key is not None and t is not None and r[0] == key and r[1] is not None and (r[1] < t if backward else r[1] > t) | (r[1] == t and not strict)]
        best = (max if backward else min)((r[1] for r in fits), default=None)
        hit = max((r for r in fits if r[1] == best), key=lambda r: r[2], default=None)
        out.append(None if hit is None or most is not None and abs(hit[1] - t) > most else hit)
    return out


@pytest.mark.parametrize("direction, strict, most", [("backward", False, None), ("backward", True, 5), ("forward", False, None), ("forward", True, None), ("nearest", False, 4)])
def test_asof_by_hand(spark, direction, strict, most):
    left = [(k % 4 if k % 9 else None, (k * 7) % 60 if k % 13 else None, k) for k in range(150)] + [(1, 30, 0)] * 3
    right = [(k % 3 if k % 8 else None, (k * 11) % 60 if k % 10 else None, k) for k in range(90)] + [(1, t % 20, 500 + t) for t in range(100)]
    got = asof.asof_join(
        spark.createDataFrame(left, "k long, t long, id long").repartition(4), spark.createDataFrame(right, "k long, t long, id long").repartition(3),
        "t", "t", {"k": "k"}, direction, strict, None if most is None else F.lit(most),
    )
    assert got.columns == ["k", "t", "id", "k_right", "t_right", "id_right"]
    back, ahead = (found_by_hand(left, right, b, strict) for b in (True, False))
    if direction == "nearest":
        hits = [b if b and (not a or row[1] - b[1] <= a[1] - row[1]) else a for row, b, a in zip(left, back, ahead)]
        hits = [h if h is None or abs(h[1] - row[1]) <= most else None for row, h in zip(left, hits)]
    else:
        hits = found_by_hand(left, right, direction == "backward", strict, most)
    assert bag(got) == Counter((*row, *(h or (None,) * 3)) for row, h in zip(left, hits))


def test_asof_of_times_without_keys(spark):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    left = spark.createDataFrame([(at(m),) for m in (0, 5, 90)], "ts timestamp_ntz")
    right = spark.createDataFrame([(at(1), "a"), (at(4), "b"), (None, "c")], "seen timestamp_ntz, what string")
    assert [r["what"] for r in asof.asof_join(left, right, "ts", "seen").orderBy("ts").collect()] == [None, "b", "b"]
    assert [r["what"] for r in asof.asof_join(left, right, "ts", "seen", within=F.expr("INTERVAL 1 HOUR"), how="inner").collect()] == ["b"]
    assert asof.asof_join(left.where("false"), right, "ts", "seen").count() == 0
    assert [r["what"] for r in asof.asof_join(left, right.where("false"), "ts", "seen").collect()] == [None] * 3


@pytest.mark.parametrize("closed", ["both", "low", "high", "none"])
@pytest.mark.parametrize("part", [40, 100_000])
def test_ranges_by_hand(spark, closed, part):
    points = [(k % 2 if k % 11 else None, float(k * k % 97) if k % 7 else None, k) for k in range(150)] + [(1, 50.0, 900 + k) for k in range(100)]
    spans = [(k % 2, float(k % 90), float(k % 90 + (k % 5) ** 3), k) for k in range(120)] + [(1, 50.0, 50.0, 7)] * 60 + [(0, None, 5.0, 8), (0, 9.0, 3.0, 9), (None, 0.0, 100.0, 10)]
    low = (lambda v, a: v >= a) if closed in ("both", "low") else (lambda v, a: v > a)
    high = (lambda v, b: v <= b) if closed in ("both", "high") else (lambda v, b: v < b)
    want = Counter((*p, *s) for p in points for s in spans if p[0] is not None and p[0] == s[0] and None not in (p[1], s[1], s[2]) and s[1] <= s[2] and low(p[1], s[1]) and high(p[1], s[2]))
    got = ranges.range_join(spark.createDataFrame(points, "g int, v double, id long"), spark.createDataFrame(spans, "g int, a double, b double, id long"), "v", "a", "b", {"g": "g"}, closed, bins=64, part=part)
    assert bag(got) == want


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 25)), min_size=1, max_size=40), st.lists(st.tuples(st.integers(0, 60), st.integers(-2, 25)), max_size=40))
def test_overlaps_by_hand(spark, one, other):
    a, b = ([(x, x + n, k) for k, (x, n) in enumerate(rows)] for rows in (one, other))
    got = ranges.overlap_join(spark.createDataFrame(a, "a int, b int, id int"), spark.createDataFrame(b, "a int, b int, id int"), "a", "b", "a", "b", bins=16)
    assert bag(got) == Counter((*x, *y) for x in a for y in b if x[0] <= x[1] and y[0] <= y[1] and x[0] <= y[1] and y[0] <= x[1])


def test_ranges_left_and_empty(spark):
    points, spans = spark.createDataFrame([(1, 5), (2, None), (2, 50)], "id int, v int"), spark.createDataFrame([(0, 10)], "a int, b int")
    assert bag(ranges.range_join(points, spans, "v", "a", "b", how="left")) == Counter([(1, 5, 0, 10), (2, None, None, None), (2, 50, None, None)])
    assert bag(ranges.range_join(points, spans.where("false"), "v", "a", "b", how="left")) == Counter([(1, 5, None, None), (2, None, None, None), (2, 50, None, None)])
    assert ranges.range_join(points.where("false"), spans, "v", "a", "b").count() == 0


def test_no_nested_loop_in_the_plan(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    bands = spark.range(100).select((F.col("id") * 5000).alias("a"), (F.col("id") * 5000 + 7000).alias("b"))
    plan = ranges.range_join(orders, bands, "o_totalprice", "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def totals_by_hand(pairs, width):
    """Of each row of intervals that is in a pair: the row, how many pairs, and the sum of the other row's last column."""
    told = {}
    for row, other in pairs:
        n, total = told.get(row, (0, 0))
        told[row] = (n + 1, total + (other[-1] or 0))
    return Counter((*row[:width], n, total) for row, (n, total) in told.items())


@pytest.mark.parametrize("closed", ["both", "low", "high", "none"])
def test_range_totals_by_hand(spark, closed):
    points = [(k % 2 if k % 11 else None, float(k * k % 97) if k % 7 else None, k if k % 5 else None) for k in range(150)] + [(1, 50.0, 900 + k) for k in range(100)] + [(0, -0.0, 1), (0, 0.0, 2), (0, 1e300, 3), (0, float("nan"), 4)]
    spans = [(k % 2, float(k % 90), float(k % 90 + (k % 5) ** 3), k) for k in range(120)] + [(1, 50.0, 50.0, 200 + k) for k in range(60)] + [(0, -0.0, 3.0, 300), (0, None, 5.0, 301), (0, 9.0, 3.0, 302), (None, 0.0, 100.0, 303)]
    low = (lambda v, a: v >= a) if closed in ("both", "low") else (lambda v, a: v > a)
    high = (lambda v, b: v <= b) if closed in ("both", "high") else (lambda v, b: v < b)
    want = totals_by_hand([(s, p) for p in points for s in spans if p[0] is not None and p[0] == s[0] and None not in (p[1], s[1], s[2]) and s[1] <= s[2] and low(p[1], s[1]) and high(p[1], s[2])], 4)
    p, s = spark.createDataFrame(points, "g int, v double, id long").repartition(4), spark.createDataFrame(spans, "g int, a double, b double, id long")
    assert bag(ranges.range_totals(p, s, "v", "a", "b", {"g": "g"}, closed, total=F.col("id"))) == want
    # A value beyond all intervals need not fit the sum's kind.
    priced = ranges.range_totals(p, s, "v", "a", "b", {"g": "g"}, closed, prices=F.col("v").cast("decimal(20,4)"))
    assert priced.agg(F.sum("n")).first()[0] == sum(row[-2] * n for row, n in want.items())
    assert ranges.range_totals(p.where("false"), s, "v", "a", "b").count() == 0 == ranges.range_totals(p, s.where("false"), "v", "a", "b").count()


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(-2, 25)), min_size=1, max_size=40), st.lists(st.tuples(st.integers(0, 60), st.integers(-2, 25)), max_size=40))
def test_overlap_totals_by_hand(spark, one, other):
    a, b = ([(k % 2, x, x + n, k) for k, (x, n) in enumerate(rows)] for rows in (one, other))
    got = ranges.overlap_totals(*(spark.createDataFrame(x, "g int, a int, b int, id int") for x in (a, b)), "a", "b", "a", "b", {"g": "g"}, total=F.col("id").cast("long"))
    assert bag(got) == totals_by_hand([(x, y) for x in a for y in b if x[0] == y[0] and x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and y[1] <= x[2]], 4)


def test_totals_make_no_pairs(spark, tmp_path):
    """50,000 prices in each of 20,000 bands, 10 to the power of 9 pairs, and as many pairs of shipments: only their totals are made."""
    from millrace import queries

    spark.range(50_000).select(F.lit(1000.0).alias("o_totalprice")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(20_000).select(F.col("id").alias("p_partkey"), F.lit(900.0).alias("p_retailprice"), F.lit(51).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    line = spark.range(60_000).select(F.col("id").alias("l_orderkey"), F.lit(7).cast("long").alias("l_suppkey"), F.lit(1).alias("l_linenumber"), F.when(F.col("id") % 2 == 0, "R").otherwise("A").alias("l_returnflag"), F.lit("1995-01-01").cast("timestamp_ntz").alias("l_shipdate"))
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = queries.range_orders_in_bands(spark, str(tmp_path)).groupBy("orders_in_band", "amount").count().collect()
    assert list(map(tuple, got)) == [(50_000, 50_000_000.0, 20_000)]
    got = queries.range_overlapping_shipments(spark, str(tmp_path)).collect()
    assert list(map(tuple, got)) == [(7, 30_000**2, 30_000 * sum(range(60_000)))]
