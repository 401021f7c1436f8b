"""Packing: exact round trip to the library's ids, gapless sequences, padding; the tokenizer; the segment tree."""

import random
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from verbspark.llm import byte_bpe
from verbspark.llm import packing as P
from verbspark.llm.queries import QUERIES, tokenizer_path

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer_path())
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def bpe():
    return byte_bpe.byte_bpe(tokenizer_path())


def encoded(texts):
    ids, bounds = bpe().encode_column(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


ODD = ["", "it's I'll we're 'tis ''s 's's x'mm 'll'd' 've'", " \n\n a  b\t\tc \n", "  ", "\n's 's", "don't'", "12ab3.5 ½ ²x", "<|endoftext|> hi", "a<|endoftext|>b <|endoftext|> <|endoftext|><|endoftext|>'s", "<|endoftext|", "<|endoftext|>", "é<|endoftext|>" * 3000, "z " * 1200000 + "<|endoftext|> z", "é́ ñ\xa0 b\xa0\xa0c\u0085d", "日本語 's x", "🙂 ok 🙂", "'", "tab\x1c\x1dx", "a_b __ 'reX 'Re", "Ԁ Ԁa ӿ", "word 's " * 400000, "y" * 3000000]


def test_ids_are_the_librarys(library):
    assert encoded(ODD) == library(ODD)
    assert encoded([None, "a"]) == [[], *library(["a"])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["'", "s", "t", "re", "ll", " ", "\n", "\t", "a", "Ab", "é", "1", "½", "-", "\xa0", "'d", "_", "\x1c", "\x85", "'ve", "日", "<|endoftext|>"]), max_size=20).map("".join), max_size=6))
def test_random_ids_are_the_librarys(library, texts):
    assert encoded(texts) == library(texts)


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        byte_bpe.ByteBpe(tokenizer_path("word_bpe_49k.json"))


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "_REMEMBERED", 5)
    texts = [f"w{k} x{k} y{k % 3}" for k in range(50)]
    b = byte_bpe.ByteBpe(tokenizer_path())
    for t, ids in zip(texts, library(texts)):
        assert b.encode_column(pa.array([t]))[0].tolist() == ids


def checked(rows, texts, library):
    """Rows of the packed pieces against the library's ids of the texts."""
    ids = {i: [*own, 1] for i, own in zip(texts, library([t or "" for t in texts.values()]))}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i])
            data = b"".join(x.to_bytes(4, "little") for x in ids[i][at : at + r.length])
            assert zlib.crc32(data) == (r.ids_crc32 if "ids_crc32" in r else zlib.crc32(bytes(r.ids)))
            at += r.length
        assert at == len(ids[i])
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_query_is_an_exact_round_trip(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert checked(QUERIES["op8_packing"](spark, DATA).collect(), texts, library) == 0


def test_edge_cases_and_small_blocks(spark, library, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_PIECES", 7)
    rng = random.Random(1)
    texts = {i: " ".join(rng.choice(("alpha", "béta", "42", "...")) for _ in range(rng.randint(0, 900))) for i in range(40)} | {40: None, 41: "", 42: "a b " * 20000, 43: "one<|endoftext|> two"}
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], "doc_id long, text string, start int, ids string").repartition(3)
    assert checked(P.pack(df, tokenizer_path()).collect(), texts, library) == 0
    repeated = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string")
    got = P.pack(repeated, tokenizer_path()).collect()
    assert len({(r.sequence_id, r.offset + k) for r in got for k in range(r.length)}) == sum(r.length for r in got) == 6
    assert P.pack(df.limit(0), tokenizer_path()).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(1, 40)), max_size=60))
def test_tree_finds_the_tightest(steps):
    tree, plain = P.CapacityTree(40), []
    for k, (put, size) in enumerate(steps):
        if put:
            tree.put(size, k)
            plain.append(size)
        else:
            found = tree.take(size)
            fits = [x for x in plain if x >= size]
            assert (found is None) == (not fits)
            if fits:
                assert found[0] == min(fits)
                plain.remove(found[0])


def test_best_fit_decreasing_by_hand():
    windows = P.best_fit_decreasing([(k, 0, n) for k, n in enumerate([5, 7, 3, 5, 2, 8])], 10)
    assert sorted(sorted(p[2] for p in w) for w in windows) == [[2, 8], [3, 7], [5, 5]]
