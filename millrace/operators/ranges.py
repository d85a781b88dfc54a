"""Range joins: values in intervals and intervals that overlap, by equal bins instead of all pairs.

Edges of equal numbers of values cut the axis into bins. An interval is sent to the bins that it meets; one
that meets many is sent to groups of bins, and those are in turn grouped, so that no interval is sent to
over 2 * FAN places. A value looks in its own bin and in the groups above it of which there are
intervals. So a pair meets in one place, by equality, and is verified there. Places that are met by too many
rows are split: their values into some parts and their intervals into others, each part meeting each.

Where only counts and sums of what meets an interval are wanted, range_totals() and overlap_totals() give
them without making a pair: ends and values are put in one order, and a total over an interval is
the difference of two running totals. Their work grows with the rows, not with the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import free_name, written
from .ordered import dealt, running

BINS, FAN = 1024, 16
#: A place is split into parts of about so many values and so many intervals.
PART = 50_000


def _axis(df: DataFrame, name: str) -> Column:
    """A column of numbers, dates or times as a double that rises with it; equal doubles only make bins coarser."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("double")
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    raise TypeError(f"{name} must be a number, a date or a time")


def _edges(df: DataFrame, value: Column, bins: int) -> list[float]:
    """At most bins - 1 rising values that cut df into about equal parts; a value that is frequent enough to be several is one."""
    shares = [k / bins for k in range(1, bins)]
    found = df.select(value.alias("v")).where("v IS NOT NULL AND NOT isnan(v)").agg(F.percentile_approx("v", shares, 100 * bins)).first()[0]
    return sorted(set(found or []))


def _bin(value: Column, edges: list[float]) -> Column:
    """How many edges are at most value, by binary search."""
    if not edges:
        return F.lit(0)
    held = F.array(*[F.lit(e) for e in edges])
    steps = [1 << k for k in reversed(range(len(edges).bit_length()))]

    def step(at: Column, width: Column) -> Column:
        return F.when((at + width <= len(edges)) & (F.try_element_at(held, at + width) <= value), at + width).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def range_join(points: DataFrame, intervals: DataFrame, value: str, low: str, high: str, by: dict[str, str] | None = None, closed: str = "both", how: str = "inner", bins: int = BINS, part: int = PART) -> DataFrame:
    """Each row of points with each row of intervals that its value lies in: low <= value <= high.

    closed says which ends belong to an interval: both, low, high or none. by pairs columns of points
    with columns of intervals that must be equal. A null value, key or end and an interval whose low is beyond its
    high match nothing; with how="left" rows of points without a match are kept, with null columns.
    Columns of intervals that points also has get the suffix _right. Rows that repeat match as often
    as they are there. The result is as long as its pairs, whatever the bins.
    """
    if closed not in ("both", "low", "high", "none") or how not in ("inner", "left"):
        raise ValueError("closed must be both, low, high or none, how inner or left")
    by = by or {}
    keys = [f"key_{k}" for k in range(len(by))]
    point = F.struct("*").alias("p")
    p = points.select(point, *[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)], F.col(f"`{value}`").alias("v"))
    p = written(p.withColumn("number", F.monotonically_increasing_id()), "points")
    q = intervals.select(F.struct("*").alias("q"), *[F.col(f"`{c}`").alias(k) for c, k in zip(by.values(), keys)], F.col(f"`{low}`").alias("low"), F.col(f"`{high}`").alias("high"))
    q = q.where("low <= high").withColumn("other", F.monotonically_increasing_id())
    for k in keys:
        q = q.where(F.col(k).isNotNull())
    edges = _edges(p, _axis(p, "v"), bins)
    top = 1
    while FAN**top <= len(edges):
        top += 1

    # The level of an interval is the first at which it meets at most FAN groups.
    ends = q.select("*", _bin(_axis(q, "low"), edges).alias("a"), _bin(_axis(q, "high"), edges).alias("b"))
    group = lambda c, level: F.floor(c / F.pow(F.lit(FAN), level)).cast("int")
    level = F.lit(top)
    for k in reversed(range(top)):
        level = F.when(group(F.col("b"), F.lit(k)) - group(F.col("a"), F.lit(k)) < FAN, k).otherwise(level)
    sent = ends.withColumn("level", level)
    sent = sent.withColumn("place", F.explode(F.sequence(group(F.col("a"), F.col("level")), group(F.col("b"), F.col("level"))))).drop("a", "b")
    sent = written(sent, "intervals")
    levels = sorted(r[0] for r in sent.select("level").distinct().collect())
    looks = p.where("v IS NOT NULL")
    for k in keys:
        looks = looks.where(F.col(k).isNotNull())
    looks = looks.withColumn("bin", _bin(_axis(p, "v"), edges))
    looks = looks.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>"))).withColumn("place", group(F.col("bin"), F.col("level"))).drop("bin")

    # Parts of a place: only places with more rows than part are in this table, so at most so many as rows / part.
    at = [*keys, "level", "place"]
    n_points = looks.groupBy(*at).agg(F.count("*").alias("n")).where(F.col("n") > part).select(*at, F.ceil(F.col("n") / part).cast("int").alias("ps"), F.lit(1).alias("qs"))
    n_intervals = sent.groupBy(*at).agg(F.count("*").alias("n")).where(F.col("n") > part).select(*at, F.lit(1).alias("ps"), F.ceil(F.col("n") / part).cast("int").alias("qs"))
    parts = written(n_points.unionByName(n_intervals).groupBy(*at).agg(F.max("ps").alias("ps"), F.max("qs").alias("qs")), "parts")
    if parts.isEmpty():
        looks, sent = (df.withColumns({"x": F.lit(0), "y": F.lit(0)}) for df in (looks, sent))
    else:
        # Each part of the values meets each part of the intervals.
        looks = looks.join(F.broadcast(parts), at, "left").withColumn("x", F.pmod("number", F.coalesce("ps", F.lit(1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.coalesce("qs", F.lit(1)) - 1))).drop("ps", "qs")
        sent = sent.join(F.broadcast(parts), at, "left").withColumn("y", F.pmod("other", F.coalesce("qs", F.lit(1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.coalesce("ps", F.lit(1)) - 1))).drop("ps", "qs")
    on = [*at, "x", "y"]
    above = F.col("v") >= F.col("low") if closed in ("both", "low") else F.col("v") > F.col("low")
    below = F.col("v") <= F.col("high") if closed in ("both", "high") else F.col("v") < F.col("high")
    met = looks.select(*on, "v", "p", "number").join(sent.select(*on, "low", "high", "q"), on).where(above & below)
    taken = {c.lower() for c in points.columns}
    names = [f"{c}_right" if c.lower() in taken else c for c in intervals.columns]
    out = met.select("p", "q", "number")
    if how == "left":
        alone = p.join(met.select("number").distinct(), "number", "left_anti").select("p", F.lit(None).cast(out.schema["q"].dataType).alias("q"), "number")
        out = out.unionByName(alone)
    return out.select("p.*", *[F.col(f"q.`{c}`").alias(n) for c, n in zip(intervals.columns, names)])


def overlap_join(left: DataFrame, right: DataFrame, low: str, high: str, other_low: str, other_high: str, by: dict[str, str] | None = None, **options) -> DataFrame:
    """Each row of left with each row of right whose interval has a point in common with its own, both ends included.

    Either the right one begins in the left one, or the left one begins in the right one and later than it: two range joins
    that have no pair in common. Nulls and ends in the wrong order match nothing; names and repeats are range_join()'s.
    """
    by = by or {}
    right_ok, left_ok = right.where(F.col(f"`{other_low}`") <= F.col(f"`{other_high}`")), left.where(F.col(f"`{low}`") <= F.col(f"`{high}`"))
    later = range_join(left_ok, right, low, other_low, other_high, by, closed="high", **options)
    names = later.columns
    first = [free_name(f"of_left_{k}", left, right) for k in range(len(left.columns))]
    renamed = left.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(left.columns, first)])
    told = dict(zip(left.columns, first))
    within = range_join(right_ok, renamed, other_low, told[low], told[high], {v: told[k] for k, v in by.items()}, **options)
    return later.unionByName(within.select(*first, *[F.col(f"`{c}`") for c in right.columns]).toDF(*names))


def _number(df: DataFrame, name: str) -> Column:
    """A column to put in order; of numbers with two zeros the negative one becomes the other."""
    held = F.col(f"`{name}`")
    return held + F.lit(0.0) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else held


def _within(df: DataFrame, first: Column, last: Column, intervals: DataFrame, low: str, high: str) -> DataFrame:
    """The rows of df that begin (first) and end (last) where they may meet an interval: not below all of them nor above."""
    least, most = free_name("least", df), free_name("most", df)
    ends = intervals.where(F.col(f"`{low}`") <= F.col(f"`{high}`")).agg(F.min(f"`{low}`").alias(least), F.max(f"`{high}`").alias(most))
    return df.join(F.broadcast(ends), (first <= F.col(most)) & (last >= F.col(least)) & (first <= last)).drop(least, most)


def _totals(events: DataFrame, intervals: DataFrame, low: str, high: str, by: list[str], closed: str, count: str, sums: list[str]) -> DataFrame:
    """intervals that meet something, with the count of, and sums over, what begins up to their high but does not end before their low.

    events has the keys (key_0 and so on), v, begins and ends (whether something begins or ends there), and the columns
    sum_0 and so on.
    """
    keys = [f"key_{k}" for k in range(len(by))]
    q = intervals.select(F.struct("*").alias("q"), *[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)], _number(intervals, low).alias("low"), _number(intervals, high).alias("high"))
    q = q.where("low <= high" if closed == "both" else "low < high")
    for k in keys:
        q, events = q.where(F.col(k).isNotNull()), events.where(F.col(k).isNotNull())
    events = events.select(*keys, "v", F.lit(1).alias("turn"), "begins", "ends", *sums)
    # An end stands before or after the equal values, as it does not or does take them in.
    turn_low, turn_high = (0 if closed in ("both", "low") else 2), (2 if closed in ("both", "high") else 0)
    ends = F.array(F.struct(F.col("low").alias("v"), F.lit(turn_low).alias("turn"), F.lit(False).alias("is_high")), F.struct(F.col("high").alias("v"), F.lit(turn_high).alias("turn"), F.lit(True).alias("is_high")))
    cut = q.withColumn("number", F.monotonically_increasing_id()).select(*keys, "number", "q", F.explode(ends).alias("e"))
    cut = cut.select(*keys, "e.v", "e.turn", "e.is_high", "number", F.when(F.col("e.is_high"), F.col("q")).alias("q"))
    d = dealt(events.unionByName(cut, allowMissingColumns=True), keys, [F.asc("v"), F.asc("turn")])
    of = {}
    for k, x in enumerate([F.lit(1).cast("long"), *[F.col(x) for x in sums]]):
        of |= {f"begun_{k}": ("sum", F.when(F.col("begins"), x)), f"ended_{k}": ("sum", F.when(F.col("ends"), x))}
    told = running(d, d.df, keys, **of).where(F.col("number").isNotNull())
    change = [F.sum(F.when(F.col("is_high"), F.coalesce(F.col(f"begun_{k}"), F.lit(0))).otherwise(-F.coalesce(F.col(f"ended_{k}"), F.lit(0)))) for k in range(len(sums) + 1)]
    out = told.groupBy("number").agg(F.first("q", ignorenulls=True).alias("q"), change[0].alias("n"), *[c.alias(x) for x, c in zip(sums, change[1:])])
    return out.where("n > 0").select("q.*", F.col("n").alias(count), *sums)


def range_totals(points: DataFrame, intervals: DataFrame, value: str, low: str, high: str, by: dict[str, str] | None = None, closed: str = "both", count: str = "n", **sums: Column) -> DataFrame:
    """Each row of intervals that a value of points lies in, with how many do (count) and the sums of some columns of points over them.

    What range_join() would give, grouped by the row of intervals, without its pairs: keys, nulls, ends and repeats
    are as there. Sums must be of an exact kind (integers, decimals) as they are differences; nulls add nothing, and a sum
    of nulls alone is 0.
    """
    if closed not in ("both", "low", "high", "none"):
        raise ValueError("closed must be both, low, high or none")
    by = by or {}
    names = [f"sum_{k}" for k in range(len(sums))]
    held = [F.col(f"`{c}`").alias(f"key_{k}") for k, c in enumerate(by)]
    # What is summed is made of what may be in an interval only: a value beyond them need not fit a decimal.
    near = _within(points, F.col(f"`{value}`"), F.col(f"`{value}`"), intervals, low, high)
    events = near.select(*held, _number(points, value).alias("v"), F.lit(True).alias("begins"), F.lit(True).alias("ends"), *[c.alias(n) for c, n in zip(sums.values(), names)])
    out = _totals(events, intervals, low, high, list(by.values()), closed, count, names)
    return out.withColumnsRenamed(dict(zip(names, sums)))


def overlap_totals(left: DataFrame, right: DataFrame, low: str, high: str, other_low: str, other_high: str, by: dict[str, str] | None = None, count: str = "n", **sums: Column) -> DataFrame:
    """Each row of left whose interval has a point in common with one of right, with how many have (count) and sums over those rows of right.

    What overlap_join() would give, grouped by the row of left, without its pairs; sums are range_totals()'s.
    """
    by = by or {}
    names = [f"sum_{k}" for k in range(len(sums))]
    held = [F.col(f"`{c}`").alias(f"key_{k}") for k, c in enumerate(by.values())]
    near = _within(right, F.col(f"`{other_low}`"), F.col(f"`{other_high}`"), left, low, high)
    spans = near.select(*held, _number(right, other_low).alias("a"), _number(right, other_high).alias("b"), *[c.alias(n) for c, n in zip(sums.values(), names)])
    sides = F.array(F.struct(F.col("a").alias("v"), F.lit(True).alias("begins")), F.struct(F.col("b").alias("v"), F.lit(False).alias("begins")))
    events = spans.withColumn("e", F.explode(sides)).select(*[f"key_{k}" for k in range(len(by))], "e.v", "e.begins", (~F.col("e.begins")).alias("ends"), *names)
    out = _totals(events, left, low, high, list(by), "both", count, names)
    return out.withColumnsRenamed(dict(zip(names, sums)))
