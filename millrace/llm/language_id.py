"""Language identification by segmentation-marginalised unigrams.

The vocabulary is fixed and public (the pieces of a tokenizer file); each language has a probability
per piece. A word's probability is the sum over all its segmentations into pieces, which a forward
algorithm gives; a text's is the product over its words. Piece probabilities are learned by
expectation maximisation over the distinct words of the labelled texts and their counts.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, forget, free_name, give_back, worker_memo, written
from .encoding import HashMemo

UNKNOWN = "und"
ROUNDS = 3
SMOOTHING = 0.05
#: A longer word is learned from in parts of so many letters (its probability would be too small for a double),
#: and scored whole, its lattice in blocks of BLOCK letters.
PART = 30
BLOCK = 4096
#: Before a part that continues a word, where U+2581 stands before a word.
_GOES_ON = "\u0001"
#: The table of probabilities goes to every task, 8 bytes for each language and piece; more labels than this are an error.
MOST_LANGUAGES = 500
#: Longer words are not remembered.
LONGEST_KNOWN = 30
MEMO_CELLS = 1_000_000
BATCH_BYTES = 1 << 20


@functools.cache
def pieces(path: str) -> dict[str, int]:
    """The letter pieces of a sentencepiece file, lower-cased ones only, each with its own number.

    A word starts with U+2581. Number 0 stands for a letter outside the vocabulary.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(k) for k in range(model.get_piece_size())}
    fit = sorted(p for p in found if (b := p.removeprefix("▁")).isalpha() and b == b.lower() or p == "▁")
    return {p: k for k, p in enumerate(fit, 1)}


@functools.cache
def _longest(path: str) -> int:
    return max(map(len, pieces(path)))


_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _prefixes(words: list[str]) -> np.ndarray:
    """Rolling hashes of all prefixes of words of one length, as (letters + 1, words)."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).T.astype(np.uint64) * _MIX
    out = np.zeros((len(letters) + 1, len(words)), np.uint64)
    for j, row in enumerate(letters):
        out[j + 1] = out[j] * np.uint64(_BASE) + (row ^ row >> np.uint64(31))
    return out


@functools.cache
def _hashed(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The pieces' hashes in order, and their numbers."""
    known = pieces(path)
    names, hashes = list(known), np.zeros(len(known), np.uint64)
    for own in _by_length(names):
        hashes[own] = _prefixes([names[k] for k in own])[-1]
    order = np.argsort(hashes)
    return hashes[order], np.fromiter(known.values(), np.int32, len(known))[order]


def lattice(words: list[str], path: str) -> np.ndarray:
    """ids[j, k, w]: the piece of word w that ends before letter j + 1 and has k + 1 letters, -1 if none.

    All words have the same number of letters, U+2581 before a word included. Substrings are looked up
    by 64-bit rolling hashes.
    """
    hashes, numbers = _hashed(path)
    most = _longest(path)
    prefix = _prefixes(words)
    n = len(prefix) - 1
    ids = np.full((n, most, len(words)), -1, np.int32)
    power = 1
    for k in range(min(n, most)):
        power = power * _BASE & 0xFFFFFFFFFFFFFFFF
        part = prefix[k + 1 :] - prefix[: n - k] * np.uint64(power)
        place = np.searchsorted(hashes, part).clip(max=len(hashes) - 1)
        ids[k:, k] = np.where(hashes[place] == part, numbers[place], -1)
    np.maximum(ids[:, 0], 0, out=ids[:, 0])
    return ids


def forward(probable: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, scale) of probable[j, k, ...], the probability of the piece of k + 1 letters that ends at j.

    alpha[most + j] sums all segmentations of the first j letters, times exp(-scale); the rows before
    are zeros, or before, the last rows of the block that these letters follow. Small values are scaled
    up on the way, so long words do not underflow.
    """
    n, most = probable.shape[:2]
    alpha = np.zeros((most + n + 1, *probable.shape[2:]))
    scale = np.zeros(probable.shape[2:])
    if before is None:
        alpha[most] = 1
    else:
        alpha[1 : most + 1] = before
    for j in range(n):
        alpha[most + j + 1] = (alpha[j + 1 : most + j + 1][::-1] * probable[j]).sum(0)
        if j % 16 == 15:
            small = alpha[most + j + 1] < 1e-60
            if small.any():
                factor = np.where(small, 1 / np.maximum(alpha[most + j + 1], 1e-250), 1.0)
                alpha[j + 1 : most + j + 2] *= factor
                scale -= np.log(factor)
    return alpha, scale


def _by_length(words: list[str]) -> Iterator[list[int]]:
    """Places of words of equal length, so many at a time that their lattices stay small."""
    by: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        by.setdefault(len(word), []).append(k)
    for n, own in by.items():
        step = max(1, (1 << 15) // (n + 1))
        for at in range(0, len(own), step):
            yield own[at : at + step]


def _long_score(word: str, path: str, p: np.ndarray) -> np.ndarray:
    """log_scores() of one word of any length: block after block, each with the piece ends of the one before."""
    most, before, total = _longest(path), None, np.zeros(len(p))
    for at in range(0, len(word), BLOCK):
        back = min(at, most - 1)
        ids = lattice([word[at - back : at + BLOCK]], path)[back:]
        alpha, scale = forward(p.T[ids].transpose(0, 1, 3, 2)[..., 0], before)
        before = alpha[-most:]
        total += scale
    return np.log(before[-1]) + total


def log_scores(words: list[str], path: str, p: np.ndarray) -> np.ndarray:
    """log of each word's probability in each language, as (words, languages)."""
    out = np.zeros((len(words), len(p)))
    words = ["▁" + w for w in words]
    for some in _by_length(words):
        if len(words[some[0]]) > BLOCK:
            for k in some:
                out[k] = _long_score(words[k], path, p)
            continue
        ids = lattice([words[k] for k in some], path)
        alpha, scale = forward(p.T[ids].transpose(0, 1, 3, 2))
        out[some] = (np.log(alpha[-1]) + scale).T
    return out


def expected(words: list[str], langs: np.ndarray, weights: np.ndarray, path: str, p: np.ndarray) -> np.ndarray:
    """Expected piece counts per language, by forward and backward sums over each word's segmentations.

    Words have at most PART letters; one that begins with _GOES_ON is a later part of a longer word.
    """
    total = np.zeros(p.size)
    words = [w[1:] if w[0] == _GOES_ON else "▁" + w for w in words]
    for some in _by_length(words):
        ids = lattice([words[k] for k in some], path)
        n, most, _ = ids.shape
        places = langs[some] * p.shape[1] + np.where(ids < 0, p.shape[1] - 1, ids)
        probable = p.ravel()[places]
        alpha, _ = forward(probable)
        beta = np.zeros_like(alpha)
        beta[-1] = weights[some] / alpha[-1]
        got = np.empty_like(probable)
        for j in range(n - 1, -1, -1):
            reach = probable[j] * beta[most + j + 1]
            got[j] = reach * alpha[j + 1 : most + j + 1][::-1]
            beta[j + 1 : most + j + 1][::-1] += reach
        total += np.bincount(places.ravel(), got.ravel(), p.size)
    return total.reshape(p.shape)


@dataclass(frozen=True)
class Model:
    """Languages and, per language, the probability of each piece; the last column is 0."""

    languages: tuple[str, ...]
    path: str
    p: np.ndarray

    @functools.cached_property
    def name(self) -> int:
        return zlib.crc32(self.p.tobytes()) ^ zlib.crc32("\0".join(self.languages).encode())


def fit(df: DataFrame, path: str, text: str = "text", label: str = "lang", rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> Model:
    """A model learned from the rows of df that have a text and a label.

    Words (runs of letters, lower-cased) are counted per language over all rows; each round of
    expectation maximisation is a job over the distinct words. What comes to the driver is a number
    per language and piece. Without such rows the model knows no language; repeated rows count again,
    other columns are not read. Words of over PART letters are learned from in parts.
    """
    parted = F.regexp_replace(F.translate(F.lower(F.col(text)), _GOES_ON, " "), f"(\\p{{L}}{{{PART}}})(?=\\p{{L}})", f"$1 {_GOES_ON}")
    word = F.explode(F.split(parted, f"[^\\p{{L}}{_GOES_ON}]+"))
    rows = df.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("lang"), word.alias("word"))
    counts = rows.where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts = written(counts, "words")
    languages = tuple(sorted(r[0] for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()))
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} labels")
    size = len(pieces(path)) + 1
    p = np.full((len(languages), size + 1), 1 / size)
    p[:, -1] = 0
    at = {x: k for k, x in enumerate(languages)}

    def job(table: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            total = np.zeros((len(languages), size + 1))
            for batch in batches:
                langs = np.array([at[x] for x in batch.column(0).to_pylist()], np.int64)
                total += expected(batch.column(1).to_pylist(), langs, batch.column(2).to_numpy().astype(float), path, table)
            total[:, -1] = 0
            lang, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[lang, piece])], ["lang", "piece", "weight"])

        return run

    for _ in range(rounds if languages else 0):
        sums = counts.mapInArrow(job(p), "lang int, piece int, weight double").groupBy("lang", "piece").agg(F.sum("weight").alias("weight"))
        got = sums.toArrow()
        new = np.zeros_like(p)
        new[got["lang"].to_numpy(), got["piece"].to_numpy()] = got["weight"].to_numpy()
        new[:, :size] += smoothing
        new[:, -1] = 0
        p = new / new.sum(1, keepdims=True)
    return Model(languages, path, p)


def _remembered(model: Model) -> HashMemo:
    """Scores of words as their bytes, remembered for one worker; the empty word's are 0."""

    def many(words: list[str]) -> pa.Array:
        own = np.zeros((len(words), len(model.languages)))
        some = [k for k, w in enumerate(words) if w]
        own[some] = log_scores([words[k] for k in some], model.path, model.p)
        width = 8 * len(model.languages)
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(np.arange(len(words) + 1, dtype=np.int64) * width), pa.py_buffer(own.tobytes())])

    return HashMemo(many, MEMO_CELLS // len(model.languages), LONGEST_KNOWN)


def _judged(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(place of the best language or -1, its share) of each text of a batch."""
    memo = worker_memo(("words", model.name), lambda: _remembered(model))
    parts = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")), r"\P{L}+")
    edges = parts.offsets.to_numpy()[:-1]
    coded = parts.flatten().dictionary_encode()
    values, place = memo.lookup(coded.dictionary)
    table = np.frombuffer(values.buffers()[2], np.float64, len(values) * len(model.languages)).reshape(len(values), -1)
    index = coded.indices.to_numpy()
    total = np.add.reduceat(table[place[index]], edges)
    letters = pc.greater(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
    some = np.add.reduceat(letters[index].astype(np.int64), edges) > 0
    best = total.argmax(1)
    share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    return np.where(some, best, -1), np.where(some, share, 0.0)


def predict(df: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the most probable language of every whole text and its share among all languages.

    Languages are equally probable beforehand. A text that is null or has no letter, or a model that
    knows no language, gives "und" and 0. Ties go to the language first in order. Repeated rows are
    judged one by one; other columns stay, but for those with the two new names.
    """

    names = pa.array([*model.languages, UNKNOWN])

    @F.arrow_udf("struct<l string, s double>")
    def judge(column: pa.Array) -> pa.Array:
        sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in column.cast(pa.large_binary())]
        best, share = [np.zeros(0, np.int64)], [np.zeros(0)]
        for a, b in byte_batches(sizes, BATCH_BYTES):
            some = _judged(column.slice(a, b - a), model) if model.languages else (np.full(b - a, -1), np.zeros(b - a))
            best.append(some[0])
            share.append(some[1])
        chosen = np.concatenate(best)
        give_back()
        return pa.StructArray.from_arrays([names.take(pa.array(np.where(chosen < 0, len(names) - 1, chosen))), pa.array(np.concatenate(share))], ["l", "s"])

    held = free_name(df, "judged")
    kept = [c for c in df.columns if c.lower() not in (lang_pred.lower(), score.lower())]
    out = df.withColumn(held, judge(F.col(text)))
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col(f"{held}.l").alias(lang_pred), F.col(f"{held}.s").alias(score))


def held_out(identifier: str = "doc_id") -> F.Column:
    """Whether crc32 of the identifier as text leaves 0 by 5; a null identifier is held out."""
    return F.coalesce(F.crc32(F.col(identifier).cast("string").cast("binary")) % 5 == 0, F.lit(True))
