"""What is kept up to date from new rows alone: views, profiles, sessions of a stream; and what changes reach."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import drift, profile, sketches
from millrace.operators.views import MaterialisedView
from millrace.streaming import sessions


def bag(df):
    return Counter(map(tuple, df.select(*sorted(df.columns)).collect()))


def test_view_reads_new_files_alone(spark, tmp_path):
    source = str(tmp_path / "rows")

    def append(lo, hi):
        spark.range(lo, hi).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 4 > 0, F.col("id")).alias("v")).coalesce(1).write.mode("append").parquet(source)

    made = {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "low": ("min", F.col("v")), "high": ("max", F.col("v"))}
    view = MaterialisedView(spark, str(tmp_path / "view"), source, {"g": F.when(F.col("g") > 0, F.col("g"))}, made, buckets=2)

    def whole():
        return spark.read.parquet(source).groupBy(F.when(F.col("g") > 0, F.col("g")).alias("g")).agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.min("v").alias("low"), F.max("v").alias("high"))

    append(0, 10)
    view.create(with_data=False)
    with pytest.raises(ValueError, match="not been populated"):
        view.read()
    assert len(view.refresh()) == 1 and bag(view.read()) == bag(whole())
    append(10, 11)
    new = view.refresh()
    assert len(new) == 1 and spark.read.parquet(*new).count() == 1 and bag(view.read()) == bag(whole())
    assert view.refresh() == [] and len(view._table.numbers()) == 3
    append(20, 25)
    again = MaterialisedView(spark, view.path, source, view.keys, made, buckets=2)
    assert len(again.refresh()) == 1 and bag(view.read()) == bag(whole())
    view.rebuild()
    assert bag(view.read()) == bag(whole()) and view.refresh() == []


def test_merged_profiles_are_close_to_exact_ones(spark, tmp_path):
    df = spark.range(30_000).select(
        F.col("id"), (F.col("id") % 700).alias("few"), F.when(F.col("id") % 5 > 0, (F.col("id") * 7919 % 10_007) / 3.0).alias("x"), F.concat(F.lit("n"), F.col("id") % 9000).alias("t"), F.lit(None).cast("double").alias("none")
    )
    for k in range(3):
        told = sketches.add(df.where(F.col("id") % 3 == k), str(tmp_path), "p")
    got, exact = ({r["column_name"]: r for r in rows.collect()} for rows in (told, profile.counts(df)))
    stats = {r["column_name"]: r for r in profile.numbers(df).collect()}
    for c, r in exact.items():
        assert (got[c]["total_count"], got[c]["null_count"], got[c]["null_percentage"]) == (r["total_count"], r["null_count"], r["null_percentage"])
        assert abs(got[c]["distinct_count"] - r["distinct_count"]) <= 0.02 * r["distinct_count"]
    for c in ("id", "few", "x"):
        assert got[c]["mean"] == pytest.approx(stats[c]["mean"], abs=1e-3) and got[c]["std_dev"] == pytest.approx(stats[c]["std_dev"], rel=1e-6)
        rank = df.agg(F.count_if(F.col(c) <= got[c]["median"]) / F.count(c)).first()[0]
        assert abs(rank - 0.5) < 0.005 and (float(got[c]["min"]), float(got[c]["max"])) == pytest.approx((stats[c]["min"], stats[c]["max"]), abs=1e-3)
    assert got["t"]["min"] == "n0" and got["t"]["median"] is None and got["none"]["mean"] is None and got["none"]["distinct_count"] == 0


def test_profiles_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "a int, t string")
    sketches.add(none, str(tmp_path), "p")
    told = {r["column_name"]: r for r in sketches.add(spark.createDataFrame([(7, "x")], none.schema), str(tmp_path), "p").collect()}
    assert (told["a"]["total_count"], told["a"]["mean"], told["a"]["std_dev"], told["a"]["median"]) == (1, 7.0, 0.0, 7.0) and told["t"]["distinct_count"] == 1


def test_sessions_of_a_stream_are_those_of_the_table(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "value")
    first, rest = events.orderBy("ts").limit(600), events.orderBy("ts").offset(600)
    landing, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = ", ".join(f"{n} {t}" for n, t in events.dtypes)

    def run():
        q = sessions.run(spark.readStream.schema(schema).parquet(landing), "ts", "user_id", out, check, "1 hour", "3 hours", "value")
        q.awaitTermination()
        return sessions.dropped(q)

    late = events.orderBy("ts").limit(5)
    dropped = 0
    for some in (first, rest, late, events.agg(F.max("ts").alias("m")).select(F.lit(-1).cast("long").alias("event_id"), (F.col("m") + F.expr("INTERVAL 5 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit(0.0).alias("value"))):
        some.coalesce(1).write.mode("append").parquet(landing)
        dropped += run()
    got = spark.read.parquet(out).where("user_id >= 0").withColumn("total", F.round("total", 6))
    want = sessions.sessions(events, "ts", "user_id", "3 hours", "value").withColumn("total", F.round("total", 6))
    assert bag(got) == bag(want) and dropped == 5


def test_sessions_by_hand(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), rng.choice([None, *range(0, 600, 5)])) for _ in range(120)] + [(3, 0), (3, 30), (3, 59)]
    df = spark.createDataFrame([(u, m) for u, m in rows], "u int, m int").select("u", (F.timestamp_seconds(F.col("m") * 60)).alias("at"))
    want = Counter()
    for u in (1, 2, 3):
        times = sorted(m for v, m in rows if v == u and m is not None)
        run = []
        for m in [*times, None]:
            if run and (m is None or m - run[-1] > 30):
                want[u, run[0], run[-1] + 30, len(run)] += 1
                run = []
            run.append(m)
    minute = lambda c: (F.unix_timestamp(c) / 60).cast("int")
    got = sessions.sessions(df, "at", "u").select("u", minute("session_start"), minute("session_end"), "events")
    assert Counter(map(tuple, got.collect())) == want


def test_what_changes_reach(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("d", "a"), ("x", "y"), ("y", "x"), ("e", "x"), ("b", "a")], "object string, needs string")
    changed = spark.createDataFrame([("a",), ("x",), ("lone",), (None,)], "object string")
    got = {(r["object"], r["cause"]): r["steps"] for r in drift.dependants(edges, changed).collect()}
    assert got == {("b", "a"): 1, ("c", "a"): 2, ("d", "a"): 1, ("y", "x"): 1, ("e", "x"): 1}
