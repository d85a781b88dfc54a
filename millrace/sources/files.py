"""Tables from files: Parquet, CSV and Excel, and result files."""

from __future__ import annotations

import csv
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = ",;\t|"
UPLOADS = ("csv", "xlsx", "xls")


def parquet_tables(spark: SparkSession, directory: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{directory}/{n}.parquet") for n in names}


def csv_dialect(spark: SparkSession, path: str, lines: int = 50) -> dict[str, str | bool]:
    """encoding, delimiter and multiline (whether quotes hold line ends) of a CSV file.

    Encoding and quotes come from one pass over all lines, split as Spark splits the file: any line that
    is no UTF-8 means a single-byte encoding, cp1252 unless bytes occur that it lacks. The delimiter comes
    from the first lines.
    """
    raw = spark.read.text(path)
    octets = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    told = raw.agg(
        F.coalesce(F.bool_and(F.expr("is_valid_utf8(value)")), F.lit(True)).alias("utf8"),
        F.coalesce(F.bool_or(octets.rlike("[\\x81\\x8D\\x8F\\x90\\x9D]")), F.lit(False)).alias("beyond"),
        F.coalesce(F.bool_or(F.regexp_count("value", F.lit('"')) % 2 == 1), F.lit(False)).alias("multiline"),
    ).first()
    head = [r[0] for r in raw.select(octets.alias("line")).limit(lines).collect()]
    marked = bool(head) and head[0].startswith("\xef\xbb\xbf")
    encoding = ("utf-8-sig" if marked else "utf-8") if told["utf8"] else "latin1" if told["beyond"] else "cp1252"
    try:
        delimiter = csv.Sniffer().sniff("\n".join(head), DELIMITERS).delimiter
    except csv.Error:
        delimiter = ","
    return {"encoding": encoding, "delimiter": delimiter, "multiline": told["multiline"]}


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """A CSV file with a header, types inferred, in the encoding and with the delimiter that it shows.

    Only a file with line ends inside quotes is read whole by one task. Windows-1252 needs the session
    setting spark.sql.legacy.javaCharsets, which is set then and stays, as the frame is read later.
    """
    found = csv_dialect(spark, path)
    charset = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "cp1252": "windows-1252", "latin1": "ISO-8859-1"}[found["encoding"]]
    if charset == "windows-1252":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return spark.read.csv(path, sep=delimiter or found["delimiter"], header=True, inferSchema=True, encoding=charset, multiLine=found["multiline"], escape='"')


def upload(spark: SparkSession, path: str, directory: str, project: str) -> str:
    """Takes a file into the project's landing folder, in place of what was there; gives its path.

    Only CSV and Excel files are taken. The copy is made by Hadoop's file system, from and to wherever Spark can read.
    """
    suffix = path.lower().rpartition(".")[2]
    if suffix not in UPLOADS:
        raise ValueError(f"no {', '.join(UPLOADS)} file: {path}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{directory}/{project}")
    system = target.getFileSystem(conf)
    system.delete(target, True)
    system.mkdirs(target)
    made = jvm.org.apache.hadoop.fs.Path(target, source.getName())
    jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, system, made, False, conf)
    return made.toString()


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook, where pandas has a reader for it. A workbook is one small file, read on the driver."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path))


def without_nan(df: DataFrame) -> DataFrame:
    """df with NaN as null in floating columns, as tables from pandas need it."""
    floating = {n for n, t in df.dtypes if t in ("double", "float")}
    return df.select(*[F.nanvl(F.col(f"`{n}`"), F.lit(None).cast(t)).alias(n) if n in floating else F.col(f"`{n}`") for n, t in df.dtypes])


def read_copy_text(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a tab-separated dump in which \\N is null."""
    return spark.read.schema(schema).csv(path, sep="\t", nullValue="\\N")


def write_csv(df: DataFrame, path: str) -> None:
    """A result as CSV: quotes where needed, null as nothing."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=False, escape='"', nullValue="", emptyValue="")


def sample_values(df: DataFrame, column: str, limit: int = 100) -> DataFrame:
    """The first values that are not null, in order of value."""
    return df.where(F.col(column).isNotNull()).select(column).orderBy(column).limit(limit)


def sample_rows(df: DataFrame, limit: int = 5) -> list[dict]:
    return [r.asDict() for r in without_nan(df).limit(limit).collect()]


def healthy(df: DataFrame) -> tuple[bool, str]:
    """Whether a source answers, and what it said if not."""
    try:
        df.limit(1).collect()
        return True, "ok"
    except Exception as e:  # any failure is the answer
        return False, str(e).splitlines()[0]
