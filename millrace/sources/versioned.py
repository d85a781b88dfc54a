"""Tables with transactions: merge, update and delete by key, snapshots, and writers that can't overwrite each other.

A table is a folder. Its rows lie in buckets by a hash of the key; a version is one small file that
names, for each bucket, the folder of Parquet files that holds it. A write puts the buckets that it
changes into new folders and then commits the next version's file by a rename that fails if the file is
there already, so of two writers one commits. Readers see the version that they began with; a write that
fails leaves files that no version names. Only changed buckets are read and written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import free_name

BUCKETS = 64
#: How often a writer takes its changes to a newer version before it gives up.
TRIES = 10


class Conflict(Exception):
    """Another writer has changed the same buckets meanwhile."""


@dataclass(frozen=True)
class Version:
    number: int
    operation: str
    schema: str  # as JSON
    keys: tuple[str, ...]
    buckets: int
    held: Mapping[int, tuple[str, int]]  # bucket -> folder, below the table's, and rows
    changed: tuple[int, ...]
    note: str = ""  # what the writer says beside, committed with the rows

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.held.values())

    def text(self) -> str:
        return json.dumps(self.__dict__)

    @staticmethod
    def of(text: str) -> Version:
        d = json.loads(text)
        return Version(**d | {"keys": tuple(d["keys"]), "changed": tuple(d["changed"]), "held": {int(k): tuple(v) for k, v in d["held"].items()}})


class VersionedTable:
    """A table under path. Columns t.* are the table's and s.* the source's in conditions and values of merge()."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._io = jvm.org.apache.commons.io.IOUtils
        self._rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    # The log

    def _commit_path(self, number: int) -> str:
        return f"{self.path}/log/{number:020d}.json"

    def numbers(self) -> list[int]:
        """All versions, in order."""
        log = self._path(f"{self.path}/log")
        if not self._fs.exists(log):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return sorted(int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit())

    def version(self, number: int | None = None) -> Version | None:
        """A version, by default the newest; None if there is none."""
        found = self.numbers()
        if not found:
            return None
        number = found[-1] if number is None else number
        if number not in found:
            raise ValueError(f"no version {number}; there are {found[0]} to {found[-1]}")
        stream = self._fs.open(self._path(self._commit_path(number)))
        try:
            return Version.of(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _try_commit(self, v: Version) -> bool:
        """Whether v became the next version: its file is written under another name and renamed, which fails if the name is taken."""
        held = self._path(f"{self.path}/log/.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(held, False)
        try:
            stream.write(bytearray(v.text().encode()))
        finally:
            stream.close()
        try:
            self._context.rename(held, self._path(self._commit_path(v.number)), self._rename)
            return True
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            self._fs.delete(held, False)
            return False

    def _commit(self, base: Version | None, new: Version) -> Version:
        """Commits new, which was made from base; where others came between that changed no bucket of new's, on top of theirs."""
        for _ in range(TRIES):
            if self._try_commit(new):
                return new
            last = self.version()
            others = [self.version(k) for k in range((base.number if base else 0) + 1, last.number + 1)]
            touched = {b for o in others for b in o.changed}
            if base is None or touched & set(new.changed) or any((o.schema, o.note) != (base.schema, base.note) for o in others):
                raise Conflict(f"versions up to {last.number} have changed what this write has read")
            theirs = {b: x for b, x in last.held.items() if b not in new.changed}
            own = {b: x for b, x in new.held.items() if b in new.changed}
            new, base = replace(new, number=last.number + 1, held=theirs | own), last
        raise Conflict(f"{TRIES} others were faster")

    # Reading

    def _read(self, v: Version, buckets: set[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(v.schema))
        held = [f"{self.path}/{f}" for b, (f, _) in sorted(v.held.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*held) if held else self.spark.createDataFrame([], schema)

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest; later writes don't change what is read."""
        v = self.version(number)
        if v is None:
            raise ValueError(f"no table at {self.path}")
        return self._read(v)

    def history(self) -> DataFrame:
        """version, operation, row_count and changed_buckets, one row a version."""
        rows = [(v.number, v.operation, v.rows, len(v.changed)) for v in map(self.version, self.numbers())]
        return self.spark.createDataFrame(rows, "version long, operation string, row_count long, changed_buckets int")

    # Writing

    def _bucket(self, keys: tuple[str, ...], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")

    def _store(self, df: DataFrame, keys: tuple[str, ...], buckets: int) -> dict[int, tuple[str, int]]:
        """df in a new folder, one below for each bucket, and there as many files as it needs; folder and rows of each."""
        folder, name = f"data/{uuid.uuid4().hex}", free_name("bucket_number", df)
        df.withColumn(name, self._bucket(keys, buckets)).hint("rebalance", name).write.partitionBy(name).parquet(f"{self.path}/{folder}")
        back = self.spark.read.option("basePath", f"{self.path}/{folder}").parquet(f"{self.path}/{folder}") if self._any(folder) else None
        counts = {r[name]: r["count"] for r in back.groupBy(name).count().collect()} if back is not None else {}
        return {b: (f"{folder}/{name}={b}", n) for b, n in counts.items()}

    def _any(self, folder: str) -> bool:
        return any(s.isDirectory() and "=" in s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{folder}")))

    def create(self, df: DataFrame, keys: list[str], buckets: int = BUCKETS, note: str = "") -> Version:
        """The first version. Rows must not share a key (a null key is no key: such rows are kept and match nothing)."""
        if self.numbers():
            raise ValueError(f"there is a table at {self.path} already")
        self._one_row_a_key(df, keys)
        held = self._store(df, tuple(keys), buckets)
        return self._commit(None, Version(1, "create", df.schema.json(), tuple(keys), buckets, held, tuple(sorted(held)), note))

    def overwrite(self, df: DataFrame, note: str | None = None) -> Version:
        """All rows anew, with df's columns; conflicts with any other write."""
        base = self._base()
        self._one_row_a_key(df, base.keys)
        held = self._store(df, base.keys, base.buckets)
        return self._commit(base, Version(base.number + 1, "overwrite", df.schema.json(), base.keys, base.buckets, held, tuple(range(base.buckets)), base.note if note is None else note))

    def restore(self, number: int) -> Version:
        """A new version that is an old one again."""
        base, old = self._base(), self.version(number)
        return self._commit(base, replace(old, number=base.number + 1, operation=f"restore {number}", changed=tuple(range(base.buckets))))

    def _base(self) -> Version:
        v = self.version()
        if v is None:
            raise ValueError(f"no table at {self.path}")
        return v

    def _one_row_a_key(self, df: DataFrame, keys: tuple[str, ...] | list[str]) -> None:
        known = reduce(lambda a, b: a & b, (F.col(f"`{k}`").isNotNull() for k in keys))
        if twice := df.where(known).groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count("*").alias("n")).where("n > 1").first():
            raise ValueError(f"several rows have the key {tuple(twice)[:-1]}")

    def _rewrite(self, base: Version, operation: str, affected: DataFrame, made: Callable[[DataFrame], DataFrame], note: str | None = None) -> Version:
        """The next version, with the buckets of the affected keys made anew from what they hold."""
        changed = {r[0] for r in affected.select(self._bucket(base.keys, base.buckets).alias("b")).distinct().collect()}
        if not changed and note in (None, base.note):
            return base
        held = self._store(made(self._read(base, changed)), base.keys, base.buckets)
        kept = {b: x for b, x in base.held.items() if b not in changed}
        return self._commit(base, replace(base, number=base.number + 1, operation=operation, held=kept | held, changed=tuple(sorted(changed)), note=base.note if note is None else note))

    def merge(self, source: DataFrame, update: Mapping[str, Column] | bool = True, insert: bool = True, delete: Column | None = None, newest: str | None = None, note: str | None = None) -> Version:
        """The next version: rows of source whose key the table has update the table's row, others are inserted.

        update names new values by column (True: all columns of the source that the table has; False: rows stay
        as they are). Rows for which delete holds go instead, and are not inserted. Both see the
        table's row as t and the source's as s. Columns that the source lacks are null in inserted rows.
        Of several rows of source with one key the one with the greatest newest counts; without
        newest, or if they tie, that is an error. A null key matches nothing, so such a row is inserted. A source without rows
        makes no version, unless note, which is committed with the rows, is new. Keys can't be updated.
        """
        base = self._base()
        columns = [f.name for f in StructType.fromJson(json.loads(base.schema)).fields]
        if lacking := [k for k in base.keys if k not in source.columns]:
            raise ValueError(f"the source has no column {', '.join(lacking)}")
        if isinstance(update, Mapping) and set(update) & set(base.keys):
            raise ValueError("a key can't be updated")
        keys = [F.col(f"`{k}`") for k in base.keys]
        known = reduce(lambda a, b: a & b, (k.isNotNull() for k in keys))
        if newest is not None:
            names, best = [free_name(f"key_{i}", source) for i in range(len(keys))], free_name("best_of_key", source)
            found = source.where(known).groupBy(*[k.alias(n) for k, n in zip(keys, names)]).agg(F.max(f"`{newest}`").alias(best))
            both = source.join(found, reduce(lambda a, b: a & b, (k == F.col(n) for k, n in zip(keys, names))), "left")
            source = both.where(~known | F.col(f"`{newest}`").eqNullSafe(F.col(best))).select(*[F.col(f"`{c}`") for c in source.columns])
        self._one_row_a_key(source, base.keys)
        values = {c: F.col(f"s.`{c}`") for c in columns if c in source.columns and c not in base.keys} if update is True else dict(update or {})
        if wrong := set(values) - set(columns):
            raise ValueError(f"the table has no column {', '.join(sorted(wrong))}")
        kinds = {f.name: f.dataType for f in StructType.fromJson(json.loads(base.schema)).fields}

        def made(before: DataFrame) -> DataFrame:
            there = free_name("is_there", before, source)
            t, s = before.withColumn(there, F.lit(True)).alias("t"), source.withColumn(there, F.lit(True)).alias("s")
            on = reduce(lambda a, b: a & b, (F.col(f"t.`{k}`") == F.col(f"s.`{k}`") for k in base.keys))
            both = t.join(s, on, "full_outer")
            old, new = F.col(f"t.{there}").isNotNull(), F.col(f"s.{there}").isNotNull()
            gone = F.lit(False) if delete is None else new & F.coalesce(delete, F.lit(False))
            out = []
            for c in columns:
                given = F.col(f"s.`{c}`") if c in source.columns else F.lit(None)
                changed = F.when(new, values[c]).otherwise(F.col(f"t.`{c}`")) if c in values else F.col(f"t.`{c}`")
                out.append(F.when(old, changed).otherwise(given).cast(kinds[c]).alias(c))
            return both.where(~gone & (old | F.lit(insert))).select(*out)

        return self._rewrite(base, "merge", source, made, note)

    def delete(self, condition: Column) -> Version:
        """The next version, without the rows for which condition holds; no version if there are none."""
        base = self._base()
        holds = F.coalesce(condition, F.lit(False))
        return self._rewrite(base, "delete", self._read(base).where(holds), lambda df: df.where(~holds))

    def update(self, values: Mapping[str, Column], condition: Column) -> Version:
        """The next version, with new values in the rows for which condition holds; no version if there are none."""
        base = self._base()
        if set(values) & set(base.keys):
            raise ValueError("a key can't be updated")
        holds = F.coalesce(condition, F.lit(False))
        kinds = {f.name: f.dataType for f in StructType.fromJson(json.loads(base.schema)).fields}

        def made(df: DataFrame) -> DataFrame:
            return df.select(*[F.when(holds, values[c]).otherwise(F.col(f"`{c}`")).cast(kinds[c]).alias(c) if c in values else F.col(f"`{c}`") for c in df.columns])

        return self._rewrite(base, "update", self._read(base).where(holds), made)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes what only versions before the last keep ones name, and those versions; how many folders went.

        Folders of writes that are under way or failed are named by no version and go too, so no writer may be at work.
        """
        found = self.numbers()
        old, kept = found[:-keep], found[-keep:]
        used = {f for k in kept for f, _ in self.version(k).held.values()}
        gone = 0
        for number in old:
            self._fs.delete(self._path(self._commit_path(number)), False)
        data = self._path(f"{self.path}/data")
        for folder in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = folder.getPath().getName()
            own = [s.getPath().getName() for s in self._fs.listStatus(folder.getPath()) if s.isDirectory()]
            lost = [b for b in own if f"data/{name}/{b}" not in used]
            for b in lost if len(lost) < len(own) else [""]:
                if b or not any(f.startswith(f"data/{name}/") for f in used):
                    self._fs.delete(self._path(f"{self.path}/data/{name}/{b}".rstrip("/")), True)
                    gone += 1
        return gone
