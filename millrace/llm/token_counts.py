"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, free_name, safe_chunks, worker_memo
from .encoding import ChunkMemo, json_encoder

BATCH_BYTES = 1 << 20


def _made(path: str) -> ChunkMemo:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    # The model puts a space before each input itself, so a chunk's own first one goes.
    return ChunkMemo(lambda chunks: map(len, model.encode([c[1:] for c in chunks], num_threads=1)))


def _piece_memo(path: str) -> ChunkMemo:
    return worker_memo(("pieces", path), lambda: _made(path))


def _lengths(texts: list[str], path: str) -> list[int]:
    """Token counts of a batch of texts, each text cut at its safe boundaries."""
    if not path.endswith(".model"):
        encoder = json_encoder(path)
        return (np.diff(encoder.encode(pa.array(texts, pa.large_string()))[1]) // encoder.width).tolist()
    cut: list[list[str]] = []
    for text in texts:
        cut.append(safe_chunks(text) if text else [])
        if text:
            cut[-1][0] = " " + cut[-1][0]
    distinct = list(set().union(*cut))
    count = dict(zip(distinct, _piece_memo(path).values(distinct))).__getitem__
    return [sum(map(count, chunks)) for chunks in cut]


def count_tokens(
    df: DataFrame,
    path: str,
    text: str = "text",
    limit: int = 4096,
    batch_bytes: int = BATCH_BYTES,
    names: tuple[str, str, str] = ("n_bytes", "n_tokens", "over_limit"),
) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit of every whole text.

    path names a tokenizer file: .model for sentencepiece, .json for tokenizers. No begin, end or
    added special tokens, truncation or padding. A null or empty text has 0 bytes and 0 tokens.
    Repeated rows are counted one by one; an empty table gives no rows. Columns of df that have one
    of the new names are replaced.

    Only lengths leave the Arrow function. Rows are encoded in batches of at most batch_bytes, long
    texts in chunks cut where no token can span the cut, so neither long nor many texts grow a batch.
    """

    @F.arrow_udf("struct<b bigint, t bigint>")
    def lengths(column: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(column.cast(pa.large_binary())), 0).cast(pa.int64())
        tokens: list[int] = []
        for a, b in byte_batches(sizes.to_pylist(), batch_bytes):
            tokens += _lengths(column.slice(a, b - a).to_pylist(), path)
        return pa.StructArray.from_arrays([sizes, pa.array(tokens, pa.int64())], ["b", "t"])

    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    held = free_name(df, "lengths")
    out = df.withColumn(held, lengths(F.col(text)))
    return out.select(
        *[F.col(f"`{c}`") for c in kept],
        F.col(f"{held}.b").alias(names[0]),
        F.col(f"{held}.t").alias(names[1]),
        (F.col(f"{held}.t") > limit).alias(names[2]),
    )
