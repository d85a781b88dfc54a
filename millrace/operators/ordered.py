"""Windows over groups of any size: running totals, ranks and frames without a task that holds a group.

Rows are range-partitioned by group and order, so a large group lies over several tasks in order. Each
task runs its own window; what a group carries from one task into the next is one row a task, as a
task's boundary lies in one group at most, so it is summed up in a small window and broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import free_name, written

#: Rows of a block in framed(); a frame that reaches further makes blocks as long as it reaches.
BLOCK = 10_000
_KINDS: dict[str, Callable] = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
_AGAIN: dict[str, Callable] = {"count": F.sum}


@dataclass(frozen=True)
class Dealt:
    """Rows in order over tasks: df has a task's number and a serial number that rises with the order."""

    df: DataFrame
    by: tuple[str, ...]
    task: str
    serial: str

    def plain(self, df: DataFrame) -> DataFrame:
        return df.drop(self.task, self.serial)


def dealt(df: DataFrame, by: list[str], order: list[Column]) -> Dealt:
    """df range-partitioned and sorted by group and order, a table. Rows equal in both are told apart as they come."""
    task, serial, tie = (free_name(n, df) for n in ("task_number", "serial_number", "tie_number"))
    keys = [*[F.asc_nulls_first(c) for c in by], *order, F.asc(tie)]
    rows = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie)
    return Dealt(written(rows.withColumns({task: F.spark_partition_id(), serial: F.monotonically_increasing_id()}), "dealt"), tuple(by), task, serial)


def _same(left: list[Column], right: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in zip(left, right)))


def running(d: Dealt, df: DataFrame, by: list[str], **of: tuple[str, Column]) -> DataFrame:
    """df (the rows of d) with a running value a name: kind (sum, count, min, max, last: the last that is not null) and column.

    A value takes in all rows of the group up to its own. Groups lie together in the order of d: by is d's, or has
    more columns by which d is ordered next.
    """
    upto = Window.partitionBy(d.task, *by).orderBy(d.serial).rowsBetween(Window.unboundedPreceding, 0)
    own = {n: _KINDS[kind](column).over(upto) for n, (kind, column) in of.items()}
    ends = [F.max_by(column, F.when(column.isNotNull(), F.col(d.serial))) if kind == "last" else _KINDS[kind](column) for kind, column in of.values()]
    keys = [free_name(f"key_{k}", df) for k in range(len(by))]
    at = free_name("at_task", df)
    held = [free_name(f"held_{k}", df) for k in range(len(of))]
    totals = df.groupBy(F.col(d.task).alias(at), *[F.col(c).alias(k) for c, k in zip(by, keys)]).agg(*[e.alias(h) for e, h in zip(ends, held)])
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(at)) == 1
    carried = [_AGAIN.get(kind, _KINDS[kind])(F.col(h)).over(before).alias(h) for (kind, _), h in zip(of.values(), held)]
    carry = totals.select(at, *keys, *carried, first.alias("is_first")).where("NOT is_first").drop("is_first")
    joined = df.withColumns(own).join(F.broadcast(carry), _same([F.col(c) for c in (d.task, *by)], [F.col(c) for c in (at, *keys)]), "left")
    merge = {"sum": lambda a, b: F.coalesce(a + b, a, b), "count": lambda a, b: a + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest, "last": F.coalesce}
    return joined.withColumns({n: merge[kind](F.col(n), F.col(h)) for (n, (kind, _)), h in zip(of.items(), held)}).drop(at, *keys, *held)


def running_totals(df: DataFrame, by: list[str], order: list[Column], **of: tuple[str, Column]) -> DataFrame:
    """df with running() values in the given order. Null groups are groups; an empty table stays empty."""
    d = dealt(df, by, order)
    return d.plain(running(d, d.df, by, **of))


def ranked(df: DataFrame, by: list[str], order: list[Column], values: list[str], place: str = "place", rank: str = "rank", dense: str = "dense_rank") -> DataFrame:
    """df with place (from 1), rank and dense rank within its group; values are the columns that order sorts by.

    Rows with equal values have one rank (nulls are equal), their places are in no certain order.
    """
    d = dealt(df, by, order)
    placed = running(d, d.df, by, **{place: ("count", F.lit(1))})
    first = running(d, placed, [*by, *values], **{rank: ("min", F.col(place))})
    out = running(d, first, by, **{dense: ("count", F.when(F.col(place) == F.col(rank), 1))})
    return d.plain(out)


def framed(df: DataFrame, by: list[str], order: list[Column], preceding: int, following: int, block: int = BLOCK, **made: Callable[[WindowSpec], Column]) -> DataFrame:
    """df with window expressions that look at so many rows before and after a row of its group, of any kind.

    Each of made gets the ordered window without a frame. Rows are cut into blocks of their group's
    order; the rows near a block's edge are also sent to the block beside it, so that a task holds a
    block and its borders, whatever the group's size.
    """
    size = max(block, preceding, following)
    d = dealt(df, by, order)
    at, own, of = free_name("place", df), free_name("own_block", df), free_name("of_block", df)
    placed = running(d, d.df, by, **{at: ("count", F.lit(1))})
    number = F.floor((F.col(at) - 1) / size)
    inside = (F.col(at) - 1) % size
    near = F.array(number, F.when(inside >= size - preceding, number + 1), F.when(inside < following, number - 1))
    sent = placed.withColumn(own, number).withColumn(of, F.explode(F.array_compact(near)))
    window = Window.partitionBy(*by, of).orderBy(at)
    return d.plain(sent.withColumns({n: f(window) for n, f in made.items()}).where(F.col(own) == F.col(of)).drop(at, own, of))
