"""Benchmark windows against a direct search of every window in every text."""

import random
import re

import pytest

from verbspark.llm import decontamination as D

DATA = "/root/testdata/sf0.01"


def split(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = split(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add("null" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w, hit, own = split(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    own |= found
        out.append((i, len(w), len(hit), sorted(own)))
    return sorted(out, key=str)


def result(df):
    rows = df.collect()
    for r in rows:
        assert all(a.start + a.length < b.start for a, b in zip(r.spans, r.spans[1:]))
    return sorted(((r[0], r.n_words, sum(s.length for s in r.spans), r["items"]) for r in rows), key=str)


def test_whole_table_against_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    expected = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
    got = result(D.find_windows(docs, bench))
    assert got == expected
    assert any(n for _, _, n, _ in got)


@pytest.mark.parametrize("block", [16 << 20, 150, 20])
def test_random_texts_in_any_number_of_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(("a", "B", "c", "é", "D-d")) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(80)] + [(80, None), (80, "")]
    items = [(k, text(rng.randint(0, 8))) for k in range(20)] + [(20, None), (None, "c c"), (21, "é"), (21, "é")]
    a = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_words int, items string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id int, text string, body int")
    assert result(D.find_windows(a, b, size=4)) == brute(docs, items, 4)
    carried = D.find_windows(a.withColumn("c0", a["text"]), b, size=4, carry=("text", "c0", "doc_id"))
    assert carried.columns == ["doc_id", "text", "c0", "n_words", "spans", "items"]
    rows = carried.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(docs, key=str) and all(r.text == r.c0 and r.n_words == len(split(r.text)) for r in rows)


def test_empty_tables_and_long_text(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "w " * 300000 + "x y z")], "doc_id long, text string")
    assert result(D.find_windows(docs, none)) == [(1, 300003, 0, [])]
    assert result(D.find_windows(docs.limit(0), none)) == []
    assert result(D.find_windows(docs, spark.createDataFrame([(7, "x. Y; z")], "item_id long, text string"))) == [(1, 300003, 3, ["7"])]
