"""As-of join: to each row the last row of the other table at or before it, within equal keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import free_name
from .ordered import dealt, running

DIRECTIONS = ("backward", "forward", "nearest")


def _searched(left: DataFrame, right: DataFrame, times: tuple[str, str], by: dict[str, str], backward: bool, strict: bool, found: str) -> DataFrame:
    """left with found: the row of right that lies nearest in one direction, as a struct, null where there is none."""
    keys, time, side = [f"key_{k}" for k in range(len(by))], "time", "side"

    def rows(df: DataFrame, on: list[str], at: str, number: int) -> DataFrame:
        own = [F.struct("*").alias(n) if k == number else F.lit(None).cast(x.select(F.struct("*")).schema[0].dataType).alias(n) for k, (n, x) in enumerate((("of_right", right), ("of_left", left)))]
        return df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(on, keys)], F.col(f"`{at}`").alias(time), F.lit(number).alias(side), *own)

    known = rows(right, list(by.values()), times[1], 0)
    for c in (*keys, time):
        known = known.where(F.col(c).isNotNull())
    both = rows(left, list(by), times[0], 1).unionByName(known)
    # Of equal times, what may match comes before the row that looks for it.
    ahead = F.desc(side) if strict else F.asc(side)
    d = dealt(both, keys, [F.asc_nulls_first(time) if backward else F.desc_nulls_first(time), ahead, F.asc_nulls_first("of_right")])
    told = running(d, d.df, keys, found=("last", F.col("of_right"))).where(F.col(side) == 1)
    for c in (*keys, time):
        told = told.withColumn("found", F.when(F.col(c).isNotNull(), F.col("found")))
    return told.select("of_left.*", F.col("found").alias(found))


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: dict[str, str] | None = None, direction: str = "backward", strict: bool = False, within: Column | None = None, how: str = "left") -> DataFrame:
    """left with the columns of the row of right that lies last at or before it (forward: first at or after it).

    by pairs columns of left with columns of right that must be equal. strict leaves out equal times.
    within, of the kind that a difference of two times has, is how far they may lie apart. nearest takes the
    nearer of both directions, the earlier one if they are equally near.

    Of rows of right at one time the one with the greatest values counts, column by column as they
    stand. A null key or time matches nothing: such a row of left has null columns from right, or goes
    with how="inner". Columns of right that left also has get the suffix _right. Every row of left
    comes once, repeated ones too. Both tables go through one range partition, so that a key of any
    number of rows lies over many tasks.
    """
    if direction not in DIRECTIONS or how not in ("left", "inner"):
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}, how left or inner")
    by, times = by or {}, (left_time, right_time)
    one, other = free_name("found_row", left, right), free_name("found_other", left, right)
    apart = lambda c: F.abs(F.col(f"`{left_time}`") - F.col(f"{c}.`{right_time}`"))
    told = _searched(left, right, times, by, direction != "forward", strict, one)
    if direction == "nearest":
        told = _searched(told, right, times, by, False, strict, other)
        nearer = F.col(one).isNotNull() & (F.col(other).isNull() | (apart(one) <= apart(other)))
        told = told.withColumn(one, F.when(nearer, F.col(one)).otherwise(F.col(other))).drop(other)
    if within is not None:
        told = told.withColumn(one, F.when(apart(one) <= within, F.col(one)))
    if how == "inner":
        told = told.where(F.col(one).isNotNull())
    taken = {c.lower() for c in left.columns}
    names = [f"{c}_right" if c.lower() in taken else c for c in right.columns]
    return told.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(f"{one}.`{c}`").alias(n) for c, n in zip(right.columns, names)])
