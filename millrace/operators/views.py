"""Materialised views over growing tables: groups with running aggregates, refreshed from the new files alone."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versioned import VersionedTable

KINDS: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "count": (F.count, lambda a, b: a + b),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


@dataclass
class MaterialisedView:
    """A grouped query over the Parquet files of a folder to which files are only ever added.

    shape joins and filters the source's rows (what it joins is read at each refresh, so changed dimensions need
    rebuild()); keys name the groups, measures the aggregates: (sum, count, min or max, column). An
    average is a sum over a count. The groups are a versioned table under path; a version also says
    which files it has seen, so a refresh adds each file once even if it is stopped and begun again.
    """

    spark: SparkSession
    path: str
    source: str
    keys: Mapping[str, Column]
    measures: Mapping[str, tuple[str, Column]]
    shape: Callable[[DataFrame], DataFrame] = field(default=lambda df: df)
    buckets: int = 8

    def __post_init__(self):
        self._table = VersionedTable(self.spark, self.path)

    def _seen(self) -> list[str]:
        return json.loads(self._table.version().note or "[]")

    def _files(self) -> list[str]:
        return sorted(self.spark.read.parquet(self.source).inputFiles())

    def _groups(self, files: list[str] | None = None) -> DataFrame:
        rows = self.shape(self.spark.read.parquet(*files) if files else self.spark.read.parquet(self.source).where("false"))
        keyed = rows.groupBy(*[c.alias(n) for n, c in self.keys.items()]).agg(*[KINDS[kind][0](c).alias(n) for n, (kind, c) in self.measures.items()])
        # A group whose key has a null is a group too, so keys are compared as text in which null is told apart.
        return keyed.select(F.to_json(F.struct(*self.keys), {"ignoreNullFields": "false"}).alias("group_key"), "*")

    def create(self, with_data: bool = True) -> None:
        """The view, filled or (with_data=False) empty; an empty one can't be read before its first refresh."""
        files = self._files() if with_data else None
        self._table.create(self._groups(files), ["group_key"], self.buckets, note=json.dumps(files) if with_data else "")

    def refresh(self) -> list[str]:
        """Adds the rows of the files that came since the last refresh; which those were. Without any nothing is written."""
        filled = bool(self._table.version().note)
        new = sorted(set(self._files()) - set(self._seen() if filled else []))
        if not new and filled:
            return []
        groups = self._groups(new)
        update = {n: KINDS[kind][1](F.col(f"t.`{n}`"), F.col(f"s.`{n}`")) for n, (kind, _) in self.measures.items()}
        note = json.dumps(sorted([*(self._seen() if filled else []), *new]))
        self._table.merge(groups, update=update, note=note)
        return new

    def rebuild(self) -> None:
        """The view from all files anew."""
        files = self._files()
        self._table.overwrite(self._groups(files), note=json.dumps(files))

    def read(self) -> DataFrame:
        if not self._table.version().note:
            raise ValueError("the view has not been populated; refresh it first")
        return self._table.read().drop("group_key")
