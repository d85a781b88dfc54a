"""Language ID: the forward sum against all segmentations, learning, held-out accuracy and odd rows."""

import math

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from millrace.llm import language_id as L
from millrace.llm.queries import op3_language_id

from .fixtures import DOCS, PIECES, clashing, corpus, empty


def every(word, p, at=0):
    """Sum over all segmentations, one by one."""
    if at == len(word):
        return 1.0
    total = 0.0
    for end in range(at + 1, min(len(word), at + 16) + 1):
        piece = L.pieces(PIECES).get(word[at:end], 0 if end == at + 1 else None)
        if piece is not None:
            total += p[piece] * every(word, p, end)
    return total


@pytest.fixture(scope="module")
def table():
    size = len(L.pieces(PIECES)) + 1
    p = np.random.default_rng(1).random((2, size + 1))
    p[:, -1] = 0
    return p / p.sum(1, keepdims=True)


def test_forward_sums_all_segmentations(table):
    words = ["the", "stone", "straße", "été", "zzzz", "日本", "a"]
    got = L.log_scores(words, PIECES, table)
    for k, w in enumerate(words):
        assert got[k].tolist() == pytest.approx([math.log(every("▁" + w, p)) for p in table])


def test_long_words_do_not_underflow(table):
    got = L.log_scores(["the" * 5000, "the"], PIECES, table)
    assert np.isfinite(got).all() and got[0, 0] < 1000 * got[1, 0] / 2


def test_long_words_are_scored_whole(table, monkeypatch):
    words = ["thestone" * 9, "straße" * 30 + "日本", "z" * 64, "the"]
    whole = L.log_scores(words, PIECES, table)
    for block in (16, 17, 40, 63):
        monkeypatch.setattr(L, "BLOCK", block)
        assert L.log_scores(words, PIECES, table) == pytest.approx(whole)


def test_languages_of_long_words_only_are_learned(spark):
    one, other = "日本語の文章には空白がない" * 4, "ภาษาไทยไม่มีช่องว่าง" * 5
    rows = [(k, w[k:] + " \x01" + w, lang) for k in range(8) for w, lang in ((one, "ja"), (other, "th"))]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES)
    assert model.languages == ("ja", "th")
    got = L.predict(spark.createDataFrame([(one[3:50],), (other[3:70],), ("ไม่มี",)], "text string"), model).collect()
    assert [r["lang_pred"] for r in got] == ["ja", "th", "th"]


def segmentations(word, at=0):
    if at == len(word):
        yield []
    for end in range(at + 1, min(len(word), at + 16) + 1):
        piece = L.pieces(PIECES).get(word[at:end], 0 if end == at + 1 else None)
        if piece is not None:
            yield from ([piece, *rest] for rest in segmentations(word, end))


def test_expected_counts_are_those_of_all_segmentations(table):
    words, weights = ["the", "stone", "straße", "日本", "\x01the"], [2.0, 3.0, 1.0, 5.0, 4.0]
    got = L.expected(words, np.array([0, 1, 0, 1, 1]), np.array(weights), PIECES, table)
    want = np.zeros_like(table)
    for word, lang, n in zip(words, (0, 1, 0, 1, 1), weights):
        ways = [(np.prod(table[lang][s]), s) for s in segmentations(word[1:] if word[0] == "\x01" else "▁" + word)]
        for chance, s in ways:
            for piece in s:
                want[lang, piece] += n * chance / sum(w for w, _ in ways)
    assert np.abs(got[:, :-1] - want[:, :-1]).max() < 1e-9


def test_predictions_are_those_of_all_segmentations(spark):
    model = L.fit(corpus(spark).where(~L.held_out()), PIECES)
    for r in L.predict(corpus(spark).where("doc_id in (1, 2, 8, 11)"), model).collect():
        found = regex.findall(r"\p{L}+", r["text"].lower())
        logs = np.array([sum(math.log(every("▁" + w, p)) for w in found) for p in model.p])
        share = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        assert r["lang_pred"] == model.languages[logs.argmax()] and r["score"] == pytest.approx(share.max())


def test_expected_counts_sum_to_pieces_per_segmentation(table):
    counts = L.expected(["ab", "the"], np.array([0, 1]), np.array([2.0, 3.0]), PIECES, table)
    for lang, word, n in ((0, "▁ab", 2.0), (1, "▁the", 3.0)):
        letters = sum(c * len(p) for p, k in L.pieces(PIECES).items() if (c := counts[lang, k])) + counts[lang, 0]
        assert letters == pytest.approx(n * len(word))


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    judged = op3_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    hits = judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert hits[0] >= 0.97 and hits[1] > 20


def test_odd_rows(spark):
    model = L.fit(corpus(spark).where(~L.held_out()), PIECES)
    assert model.languages == ("en", "fr") and model.p.sum(1).tolist() == pytest.approx([1, 1])
    rows = L.predict(clashing(spark), model).collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] in model.languages) == letters and 0 <= r["score"] <= 1 and r["judged"] == "mine"
    assert L.predict(empty(spark), model).count() == 0
    none = L.fit(empty(spark), PIECES)
    assert none.languages == () and {(r["lang_pred"], r["score"]) for r in L.predict(corpus(spark), none).collect()} == {("und", 0.0)}
