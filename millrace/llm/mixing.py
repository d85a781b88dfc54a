"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of (source, language, topic). Raking scales the cells' tokens until
the sums over each of the three agree with target shares; a cell's factor, times one constant, is the
expected number of copies of each of its documents: whole copies and one more by a draw for the rest.
So the drawn tokens have the target shares, those of rare cells too.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import discard, forget, free_name, written

MARGINS = ("source", "lang", "topic")
#: Without targets, a share is proportional to the tokens' count to this power.
TEMPER = 0.5
TOPICS = 8
TOPIC_LETTERS = 6
#: Most rounds of raking, in an array and as a table alike; fewer where no weight moves by over TOLERANCE of all tokens.
ROUNDS = 5000
TOLERANCE = 1e-9
#: So many cells are raked in one array and joined by broadcast; more are raked as a table.
MOST_CELLS = 100_000

_TOPIC = StructType([StructField("topic", StringType()), StructField("n_tokens", LongType())])


@F.arrow_udf(_TOPIC)
def _describe(column: pa.Array) -> pa.Array:
    forget()
    topics, tokens = [], []
    for text in column:
        found = (text.as_py() or "").lower().split()
        tokens.append(len(found))
        counts = Counter(w for w in found if len(w) >= TOPIC_LETTERS)
        word = min(counts, key=lambda w: (-counts[w], w)) if counts else None
        topics.append("none" if word is None else f"t{zlib.crc32(word.encode()) % TOPICS}")
    return pa.StructArray.from_arrays([pa.array(topics), pa.array(tokens, pa.int64())], ["topic", "n_tokens"])


#: Told to be nondeterministic, so that Spark makes each row's value once and does not put a copy into every filter and
#: join key that reads it; each copy would be another Python worker beside the first, with the memory of one.
_once = _describe.asNondeterministic()


def describe(text: Column) -> Column:
    """topic and n_tokens of each whole text.

    Tokens are words between white space. Where a corpus has no topic column, this names one of TOPICS
    by the hash of the most frequent word of TOPIC_LETTERS letters or more (of equally frequent ones
    the first in order); "none" without such a word.
    """
    return _once(text)


def count_cells(df: DataFrame, margins: tuple[str, ...] = MARGINS, tokens: str = "n_tokens") -> DataFrame:
    """The margins, the sum of tokens and the documents with tokens of each cell; a null value is a value of its own."""
    sums = F.sum(F.coalesce(tokens, F.lit(0))).cast("double").alias("tokens"), F.count_if(F.col(tokens) > 0).cast("double").alias("docs")
    return df.groupBy(*margins).agg(*sums).where("tokens > 0")


def _shares(sums: dict, wanted: dict | None) -> dict:
    raw = {k: float(wanted.get(k, 0.0)) for k in sums} if wanted is not None else {k: v**TEMPER for k, v in sums.items()}
    total = sum(raw.values())
    if total <= 0:
        raise ValueError("no target share for any value that occurs")
    return {k: v / total for k, v in raw.items()}


def rake_array(keys: list[tuple], tokens: np.ndarray, targets: dict[int, dict] | None = None, rounds: int = ROUNDS, most_factor: float | None = None) -> np.ndarray:
    """Raked weights of cells, of the same sum as tokens. targets has shares by a margin's place.

    Only a caller's most_factor trims factors; a trimmed cell stays below its target, as reached() shows.
    """
    total, weight = tokens.sum(), tokens.astype(float).copy()
    margins = []
    for m in range(len(keys[0])):
        values = sorted({k[m] for k in keys}, key=lambda v: (v is not None, str(v)))
        number = {v: k for k, v in enumerate(values)}
        at = np.array([number[k[m]] for k in keys])
        sums = np.bincount(at, tokens, len(values))
        shares = _shares(dict(zip(values, sums)), (targets or {}).get(m))
        margins.append((at, np.array([shares[v] for v in values]) * total))
    for _ in range(rounds):
        before = weight.copy()
        for at, goal in margins:
            sums = np.bincount(at, weight, len(goal))
            weight *= np.divide(goal, sums, out=np.zeros_like(goal), where=sums > 0)[at]
        if most_factor is not None:
            weight = np.minimum(weight, most_factor * tokens)
        if np.abs(weight - before).max() <= TOLERANCE * total:
            break
    return weight


def rake_table(cells: DataFrame, margins: tuple[str, ...], targets: dict[str, dict] | None, rounds: int = ROUNDS, most_factor: float | None = None) -> DataFrame:
    """cells with weight, raked by one aggregation and one join a margin, as rake_array() does; a round is written to the shared folder and the one before deleted."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0]
    current = held = written(cells.withColumn("weight", F.col("tokens")), "cells")
    goals = {}
    for m in margins:
        sums = cells.groupBy(m).agg(F.sum("tokens").alias("t"))
        if targets and m in targets:
            named = spark.createDataFrame(list(targets[m].items()), f"v {dict(cells.dtypes)[m]}, raw double")
            sums = sums.join(named, sums[m].eqNullSafe(named["v"]), "left").select(m, F.coalesce("raw", F.lit(0.0)).alias("raw"))
        else:
            sums = sums.select(m, F.pow("t", F.lit(TEMPER)).alias("raw"))
        goals[m] = written(sums.select(F.col(m).alias("v"), (F.col("raw") / sums.agg(F.sum("raw")).first()[0] * total).alias("goal")), "goals")
    for _ in range(rounds):
        step = current.withColumn("before", F.col("weight"))
        for m in margins:
            factor = step.groupBy(F.col(m).alias("f")).agg(F.sum("weight").alias("s"))
            factor = factor.join(goals[m], F.col("f").eqNullSafe(F.col("v"))).select("f", F.when(F.col("s") > 0, F.col("goal") / F.col("s")).otherwise(0.0).alias("factor"))
            step = step.join(factor, F.col(m).eqNullSafe(F.col("f"))).withColumn("weight", F.col("weight") * F.col("factor")).drop("f", "factor")
        if most_factor is not None:
            step = step.withColumn("weight", F.least("weight", F.col("tokens") * most_factor))
        step = written(step, "raked")
        moved = step.agg(F.max(F.abs(F.col("weight") - F.col("before")))).first()[0]
        discard(held)
        held, current = step, step.drop("before")
        if moved is None or moved <= TOLERANCE * total:
            break
    return current


def calibrate(cells: DataFrame, margins: tuple[str, ...] = MARGINS, targets: dict[str, dict] | None = None, share: float | None = None, most_cells: int = MOST_CELLS, most_factor: float | None = None) -> tuple[DataFrame, bool]:
    """The cells with tokens, weight (their raking factor), expected (copies of each document) and probability (of
    at least one); whether they are few enough to broadcast.

    targets has, for each margin named there, shares by value (a value not named gets none); other
    margins get tempered shares. Copies are the factors times share, the drawn tokens as a share of all. Without
    share these are as many tokens as there are, or fewer so that no more documents are drawn than there are
    (three deviations of the draw below that); for that, cells have docs as count_cells() gives them.
    """
    spark = cells.sparkSession
    cells = cells if "docs" in cells.columns else cells.withColumn("docs", F.lit(0.0))
    some = cells.limit(most_cells + 1).collect()
    few = len(some) <= most_cells
    kinds = ", ".join(f"`{m}` {dict(cells.dtypes)[m]}" for m in margins)
    if few:
        some.sort(key=lambda r: [(r[m] is not None, str(r[m])) for m in margins])
        keys = [tuple(r[m] for m in margins) for r in some]
        tokens = np.array([r["tokens"] for r in some])
        by = {k: targets[m] for k, m in enumerate(margins) if targets and m in targets}
        weight = rake_array(keys, tokens, by, most_factor=most_factor) if keys else tokens
        # As an Arrow table: rows of Python objects would pass through Python workers of another kind, which stay beside those at hand.
        given = [pa.array([k[m] for k in keys], to_arrow_type(cells.schema[name].dataType)) for m, name in enumerate(margins)]
        given += [pa.array(v, pa.float64()) for v in ([r["docs"] for r in some], tokens, weight)]
        raked = spark.createDataFrame(pa.Table.from_arrays(given, [*margins, "docs", "tokens", "weight"]), f"{kinds}, docs double, tokens double, weight double")
    else:
        raked = rake_table(cells, margins, targets, most_factor=most_factor)
    factor = F.col("weight") / F.col("tokens")
    if share is None:
        given, drawn = (v or 0.0 for v in raked.agg(F.sum("docs"), F.sum(F.col("docs") * factor)).first())
        share = min(1.0, max(given - 1.5 * given**0.5, given / 2) / drawn) if drawn else 1.0
    expected = factor * share
    return raked.select(*margins, "tokens", factor.alias("weight"), expected.alias("expected"), F.least(F.lit(1.0), expected).alias("probability")), few


def reached(cells: DataFrame, margins: tuple[str, ...] = MARGINS, targets: dict[str, dict] | None = None) -> DataFrame:
    """margin, value, target and reached share of every value of every margin of calibrate()'s cells.

    They differ where targets contradict each other or a value's cells, or factors were trimmed.
    """
    out = []
    for m in margins:
        sums = cells.groupBy(F.col(m).alias("v")).agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("weight")).alias("w"))
        if targets and m in targets:
            named = cells.sparkSession.createDataFrame(list(targets[m].items()), f"k {dict(cells.dtypes)[m]}, raw double")
            sums = sums.join(named, F.col("v").eqNullSafe(F.col("k")), "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
        else:
            sums = sums.withColumn("raw", F.pow("t", F.lit(TEMPER)))
        whole = sums.agg(F.sum("raw").alias("raws"), F.sum("w").alias("ws"))
        out.append(sums.crossJoin(whole).select(F.lit(m).alias("margin"), F.col("v").cast("string").alias("value"), (F.col("raw") / F.col("raws")).alias("target"), (F.col("w") / F.col("ws")).alias("reached")))
    return reduce(DataFrame.unionByName, out)


def draw(*of: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the given columns and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 53)) / F.lit(float(1 << 53))


def drawn_copies(expected: Column, *identity: Column, seed: int = 0) -> Column:
    """How many copies of a document are drawn: expected's whole part, and one more with the rest as probability."""
    whole = F.floor(expected)
    return whole.cast("int") + (draw(*identity, seed=seed) < expected - whole).cast("int")


def with_probability(df: DataFrame, cells: DataFrame, few: bool, identity: list[str], margins: tuple[str, ...] = MARGINS, seed: int = 0) -> DataFrame:
    """df with weight, probability, copies and selected (copies > 0); a document without tokens has 0, 0, 0 and false.

    The draw depends on the identity columns, so equal rows are drawn alike and a job that runs
    again draws the same documents.
    """
    renamed = cells.select(*[F.col(m).alias(f"cell_{k}") for k, m in enumerate(margins)], "weight", "probability", "expected")
    on = reduce(lambda a, b: a & b, [df[m].eqNullSafe(renamed[f"cell_{k}"]) for k, m in enumerate(margins)])
    joined = df.join(F.broadcast(renamed) if few else renamed, on, "left").drop(*[f"cell_{k}" for k in range(len(margins))])
    filled = joined.withColumn("weight", F.coalesce("weight", F.lit(0.0))).withColumn("probability", F.coalesce("probability", F.lit(0.0)))
    filled = filled.withColumn("copies", drawn_copies(F.coalesce("expected", F.lit(0.0)), *map(F.col, identity), seed=seed)).drop("expected")
    return filled.withColumn("selected", F.col("copies") > 0)


def mixed(docs: DataFrame, identifier: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", seed: int = 0, **options) -> DataFrame:
    """Every row of docs with topic, n_tokens, weight, probability, copies and selected, and identifier, source and lang.

    Null source or lang is a value of its own; a null or blank text has no tokens and is not drawn;
    repeated rows are drawn alike; an empty table gives no rows. No text is in the result.
    """
    told = docs.select(identifier, source, lang, F.xxhash64(text).alias("text_hash"), describe(F.col(text)).alias("d"))
    told = written(told.select(F.col(identifier).alias("id"), F.col(source).alias("source"), F.col(lang).alias("lang"), "d.topic", "d.n_tokens", "text_hash"), "told")
    cells, few = calibrate(count_cells(told), **options)
    out = with_probability(told, cells, few, ["id", "text_hash"], seed=seed)
    return out.select(F.col("id").alias(identifier), F.col("source").alias(source), F.col("lang").alias(lang), "topic", "n_tokens", "weight", "probability", "copies", "selected")


def sample(docs: DataFrame, identifier: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", seed: int = 0, **options) -> DataFrame:
    """The drawn rows of docs, with docs' own columns, each as often as mixed() has copies of it."""
    held = free_name(docs, "described")
    told = docs.withColumn(held, describe(F.col(text)))
    margins = docs.select(F.col(source).alias("source"), F.col(lang).alias("lang"), describe(F.col(text)).alias("d")).select("source", "lang", "d.topic", "d.n_tokens")
    cells, few = calibrate(count_cells(margins), **options)
    own, chance = free_name(told, "cell"), free_name(told, "chance")
    cells = cells.select(F.struct("source", "lang", "topic").alias(own), F.col("expected").alias(chance))
    cell = F.struct(F.col(source).alias("source"), F.col(lang).alias("lang"), F.col(f"{held}.topic").alias("topic"))
    joined = told.join(F.broadcast(cells) if few else cells, cell.eqNullSafe(F.col(own)))
    copies = drawn_copies(F.col(chance), F.col(identifier).cast("long"), F.xxhash64(text), seed=seed)
    again = free_name(joined, "again")
    drawn = joined.where(F.col(f"{held}.n_tokens") > 0).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(True), copies)).alias(again))
    return drawn.drop(again)
