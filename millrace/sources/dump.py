"""Tables of a database dump: the COPY sections of one text file, found and read by byte ranges.

An index job deals the file out by bytes and tells where sections begin and end. A table is then read by
a data source of its own: each partition takes the lines that begin in its bytes of the section and
decodes only the columns that are asked for.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SPLIT = 64 << 20
BLOCK = 4 << 20
ROWS = 10_000
HEADER = re.compile(rb'COPY ("(?:[^"]|"")+"|[^\s(]+) ?\(([^)]*)\) FROM stdin;')
_ESCAPES = {b"b": b"\b", b"f": b"\f", b"n": b"\n", b"r": b"\r", b"t": b"\t", b"v": b"\v"}
_ESCAPED = re.compile(rb"\\(x[0-9a-fA-F]{1,2}|[0-7]{1,3}|.)", re.S)
#: A section: columns as they stand in its lines, and the bytes of its lines.
SECTION = "table_name string, columns array<string>, first long, end long"


def _opened(path: str):
    """The file, to read from any byte. pyarrow must know the kind of its address."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def _lines(path: str, first: int, end: int, at_line: bool) -> Iterator[tuple[int, bytes]]:
    """(place, line without its end) of the lines that begin in some bytes; at_line says whether one begins at the first of them."""
    with _opened(path) as f:
        place = first if at_line else first - 1
        f.seek(place)
        rest, skip = b"", not at_line
        while place < end:
            block = f.read(BLOCK)
            rest += block
            *whole, rest = rest.split(b"\n") if block else [rest, b""]
            for line in whole:
                if skip:
                    skip = False
                elif place < end:
                    yield place, line
                else:
                    return
                place += len(line) + 1
            if not block:
                return


def _plain(name: bytes) -> str:
    """A table's name without its schema and quotes."""
    return name.decode().rpartition(".")[2].strip('"')


def sections(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The COPY sections of a dump, SECTION, in their order; the file is scanned once, by split bytes a task.

    A line within a section is never taken for the head of another one. A section without its end goes to the file's
    end; text outside of sections is passed over. An empty file has none.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(where).getLen()
    parts = -(-size // split)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in batch.column(0).to_pylist():
                for place, line in _lines(path, k * split, min(size, (k + 1) * split), k == 0):
                    line = line.rstrip(b"\r")
                    if line == b"\\.":
                        rows.append({"place": place, "after": place, "name": None, "columns": None})
                    elif line.startswith(b"COPY ") and (m := HEADER.fullmatch(line)):
                        rows.append({"place": place, "after": place + len(line) + 1, "name": _plain(m[1]), "columns": [c.strip().strip(b'"').decode() for c in m[2].split(b",")]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("place", pa.int64()), ("after", pa.int64()), ("name", pa.string()), ("columns", pa.list_(pa.string()))]))

    marks = spark.range(0, parts, 1, max(1, parts)).mapInArrow(scan, "place long, after long, name string, columns array<string>")
    out, open_ = [], None
    for r in sorted(marks.collect(), key=lambda r: r["place"]):  # two marks a table
        if open_ is None and r["name"] is not None:
            open_ = r
        elif open_ is not None and r["name"] is None:
            out.append((open_["name"], open_["columns"], open_["after"], r["place"]))
            open_ = None
    if open_ is not None:
        out.append((open_["name"], open_["columns"], open_["after"], size))
    return spark.createDataFrame(out, SECTION)


def _value(field: bytes) -> str | None:
    """A field's text: \\N is null, a backslash begins an escape."""
    if field == b"\\N":
        return None
    if b"\\" in field:
        field = _ESCAPED.sub(lambda m: _ESCAPES.get(m[1]) or (bytes([int(m[1][1:], 16)]) if len(m[1]) > 1 and m[1][:1] == b"x" else bytes([int(m[1], 8) & 255]) if m[1].isdigit() and m[1][:1] < b"8" else m[1]), field)
    return field.decode()


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.path, self.first, self.end = options["path"], int(options["first"]), int(options["end"])
        self.split = int(options.get("split", SPLIT))
        held = json.loads(options["columns"])
        if lacking := [n for n in schema.names if n not in held]:
            raise ValueError(f"the dump's table has no column {', '.join(lacking)}")
        self.names, self.places = schema.names, [held.index(n) for n in schema.names]

    def partitions(self) -> list[InputPartition]:
        # Without a partition Spark would read one of its own.
        return [InputPartition((a, min(self.end, a + self.split))) for a in range(self.first, max(self.end, self.first + 1), self.split)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        a, b = partition.value
        columns: list[list] = [[] for _ in self.names]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], self.names)

        for _, line in _lines(self.path, a, b, a == self.first):
            fields = line.removesuffix(b"\r").split(b"\t")
            for c, k in zip(columns, self.places):
                c.append(_value(fields[k]))
            if len(columns[0]) >= ROWS:
                yield batch()
                columns = [[] for _ in self.names]
        if columns[0]:
            yield batch()


class DumpSource(DataSource):
    """Format sql_dump: some columns of one section, all of them text. Options: path, columns (of the section, as JSON), first, end, split."""

    @classmethod
    def name(cls) -> str:
        return "sql_dump"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in json.loads(self.options["columns"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def read_table(spark: SparkSession, path: str, table: str, schema: str, split: int = SPLIT, index: DataFrame | None = None) -> DataFrame:
    """The named columns of a table of a dump, in the types of schema (a list of names and types); index saves scanning the dump again.

    A table that has several sections has the rows of all. A field that does not fit its type stops the job; empty text is empty, \\N is null.
    """
    spark.dataSource.register(DumpSource)
    kinds = spark.createDataFrame([], schema).schema
    found = (sections(spark, path, split) if index is None else index).where(F.col("table_name") == table).collect()
    if not found:
        raise ValueError(f"the dump has no table {table}")
    out = None
    for s in found:
        text = spark.read.format("sql_dump").schema(", ".join(f"`{n}` string" for n in kinds.names))
        rows = text.options(path=path, columns=json.dumps(s["columns"]), first=s["first"], end=s["end"], split=split).load()
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kinds.fields])
        out = rows if out is None else out.unionByName(rows)
    return out


def as_lines(df: DataFrame) -> DataFrame:
    """The rows of df as lines (value) of a COPY section: tabs between, \\N for null, escapes where a text needs them."""

    def field(name: str):
        text = F.col(f"`{name}`").cast("string")
        for plain, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            text = F.replace(text, F.lit(plain), F.lit(escaped))
        return F.coalesce(text, F.lit("\\N"))

    return df.select(F.concat_ws("\t", *[field(c) for c in df.columns]).alias("value"))
