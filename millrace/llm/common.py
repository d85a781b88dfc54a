"""What the operators of this subpackage share: tables, the shared folder, safe text chunks."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where that is unset, a folder is made in the driver's temporary one, but only in local mode, where
    driver and executors are one process; on a cluster that would lose data, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named:
        if not context.getCheckpointDir():
            if not context.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-checkpoint-"))
        return context.getCheckpointDir().rstrip("/")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/millrace-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df as a table written once in the shared folder and read back: lineage is cut there. options are the writer's."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    schema = df.schema
    with small_batches(spark):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _folders[out] = path
    return out


#: Where written() has put a table.
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made and that nothing reads any more, and the shuffle files of what they were made from.

    A table goes when what follows from it has been written, so a job that loses executors still finds all that it reads. The
    driver's JVM is told to collect its garbage: Spark removes the shuffle files of plans that are gone.
    """
    for df in tables:
        path = _folders.pop(df)
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


#: Rows of whole texts in an Arrow batch where an operator runs its own job: some MB, on either side of the pipe.
BATCH_ROWS = 1000


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Jobs started inside send at most so many rows at once to Python; the session's own setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def free_name(df: DataFrame, wish: str) -> str:
    """wish, or a variant of it that no column of df has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name, k = wish, 0
    while name.lower() in taken:
        k += 1
        name = f"{wish}_{k}"
    return name


def words(text: str) -> "F.Column":
    """Maximal runs of [^\\x20\\x09-\\x0D]; null text has none."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


# A space is no safe cut next to other white space, to U+2581 or to a text's end.
UNSAFE_CUT = re.compile("[\\s▁] | [\\s▁]|^ | $")
_EDGE = re.compile("[\\s▁]")


def safe_chunks(text: str) -> list[str]:
    """text cut before single spaces, so that no token of either tokenizer family spans a cut.

    A cut lies before a space whose neighbours are both neither white space nor U+2581. Every
    chunk but the first then starts with that space, and the chunks joined give text again.
    Byte-level BPE splits there before merging; in the piece vocabulary no piece has U+2581
    behind another character. A text without a safe cut is one chunk.
    """
    parts = text.split(" ")
    if len(parts) > 1 and UNSAFE_CUT.search(text):
        out = [parts[0]]
        for part in parts[1:]:
            last = out[-1]
            if last and part and not _EDGE.match(last[-1]) and not _EDGE.match(part[0]):
                out.append(part)
            else:
                out[-1] = f"{last} {part}"
        parts = out
    return [parts[0], *[" " + p for p in parts[1:]]]


def byte_batches(sizes: list[int], most: int) -> Iterable[tuple[int, int]]:
    """Ranges of neighbouring rows whose sizes add up to at most most (a larger row stands alone)."""
    start = total = 0
    for at, size in enumerate(sizes):
        if at > start and total + size > most:
            yield start, at
            start, total = at, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


_memo: dict[Hashable, object] = {}


def worker_memo(key: Hashable, make: Callable[[], object]):
    """What this Python worker remembers under key, made where it is not at hand.

    Spark hands a worker from stage to stage, so a worker holds one operator's memo at a time: one
    made for another key goes first.
    """
    if key not in _memo:
        _memo.clear()
        give_back()
        _memo[key] = make()
    return _memo[key]


def forget() -> None:
    """Drops what this worker remembers for another operator; for those that remember nothing themselves."""
    if _memo:
        _memo.clear()
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: what Arrow's pool and the C library's heap would keep for later batches."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


@functools.cache
def _trim() -> Callable | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)
