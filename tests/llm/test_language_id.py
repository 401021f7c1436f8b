"""Language identification: held-out accuracy, gram counts, awkward texts."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from verbspark.llm import language_id as L
from verbspark.llm.queries import QUERIES, fold

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op10_language_id"](spark, DATA).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def plain_counts(text):
    out = np.zeros(L.GRAMS)
    data = [0x20, *(int(L._TABLE[b]) for b in text.encode()), 0x20]
    for a, b, c in zip(data, data[1:], data[2:]):
        if b != 0x20:
            out[(((a << 16 | b << 8 | c) * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - L.BITS)] += 1
    return out


def test_counts_across_blocks_and_texts(monkeypatch):
    rng = random.Random(3)
    texts = ["", "a", "É", "ab cd", "", " x1y ", *("".join(rng.choice("abcé ñ.") for _ in range(rng.randint(0, 40))) for _ in range(60)), ""]
    expected = np.stack([plain_counts(t) for t in texts])
    for block in (1 << 20, 7, 64):
        monkeypatch.setattr(L, "_BLOCK", block)
        assert (L.gram_counts(pa.array(texts)) == expected).all()


def test_edge_cases(spark):
    rows = [(i, ("der die das und nicht " if i % 2 else "the of and with that ") * 5, "de" if i % 2 else "en") for i in range(40)]
    rows += [(100, None, "de"), (101, "", "en"), (102, "12 34 !?", "en"), (103, "x", None), (104, "日本", None), (None, "nicht der das", None), (105, "the of " * 100000, None), (105, "the of", None)]
    df = spark.createDataFrame([(*r, 1.0, "q") for r in rows], "doc_id long, text string, lang string, score double, body string")
    model = L.learn(df, F.lit(True))
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in L.identify(df, model).collect()]
    assert {(100, "und", True), (101, "und", True), (102, "und", True), (0, "en", False), (1, "de", False)} <= set(got)
    assert [lang for i, lang, _ in got if i == 105] == ["en", "en"] and [lang for i, lang, _ in got if i is None] == ["de"]
    assert any(i == 104 and lang != "und" and rejected for i, lang, rejected in got)
    none = L.learn(df.limit(0), F.lit(True))
    assert {r.lang_pred for r in L.identify(df, none).collect()} == {"und"}
    assert L.identify(df.limit(0), model).collect() == []
    assert df.where(fold(5).isNull()).count() == 0


def test_predictions_row_by_row(spark):
    """Every prediction of a table again, by plain gram counts and cosines."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.learn(docs, fold(5) != 0)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in L.identify(docs, model).collect():
        text = texts[r.doc_id]
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        v = np.log1p(plain_counts(text)) * model.weights
        cosine = [float(v @ c) / np.linalg.norm(v) for c in model.centroids]
        best = int(np.argmax(cosine))
        assert r.lang_pred == model.languages[best] and abs(r.score - cosine[best]) < 1e-5
        assert r.rejected == (cosine[best] < model.least[best]) or abs(cosine[best] - model.least[best]) < 1e-5


def test_the_sample_is_bounded_for_any_ids_and_copies(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "fit", lambda counts, languages, real=L.fit: seen.append(languages) or real(counts, languages))
    docs = spark.range(4000).selectExpr("CAST(NULL AS bigint) AS doc_id", "concat('word ', if(id % 3 = 0, 'same', char(97 + id % 26) || char(97 + id % 23))) AS text", "if(id % 2 = 0, 'a', 'b') AS lang")
    L.learn(docs, F.lit(True), per_language=30)
    assert 0 < seen[0].count("a") <= 60 and 0 < seen[0].count("b") <= 60
