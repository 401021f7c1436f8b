"""The pipeline's stages, each against brute force on what the stage before kept."""

import corpus_pipeline as C
import pytest
from pyspark.sql import functions as F
from tests.llm.test_decontamination import brute as hits
from tests.llm.test_minhash_dedup import brute as groups
from tests.llm.test_secret_ledger import base_spans
from tokenizers import Tokenizer
from verbspark.llm.queries import tokenizer_path

DATA = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The documents and what each stage wrote."""
    folder = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for name, stage in C.STAGES:
        stage(spark, out[-1], DATA).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def rows(df):
    return {r.doc_id: tuple(r) for r in df.collect()}


def test_stages(tables):
    raw, clean, single, apart, masked, packed = tables
    assert [name for name, _ in C.STAGES] == ["toxicity", "near_dedup", "decontamination", "secret_scan", "packing"]
    assert all(t.columns == COLUMNS for t in tables[:-1])
    before, after = rows(raw), rows(clean)
    assert after.items() <= before.items() and 0 < len(before) - len(after) < 0.25 * len(before)

    kept = groups([(i, r[1]) for i, r in after.items()])
    assert rows(single) == {i: r for i, r in after.items() if kept[i][2]}

    bench = [tuple(r) for r in tables[0].sparkSession.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {i for i, _, n, _ in hits([(i, r[1]) for i, r in rows(single).items()], bench) if n}
    assert hit and rows(apart) == {i: r for i, r in rows(single).items() if i not in hit}

    old, new = rows(apart), rows(masked)
    assert old.keys() == new.keys()
    for i, r in new.items():
        assert not base_spans(r[1] or "")
        assert (r == old[i]) or ("[secret]" in r[1] and r[4] == len(r[1]) and r[2:4] == old[i][2:4])
        assert base_spans(old[i][1] or "") == [] or r != old[i]

    t = Tokenizer.from_file(tokenizer_path())
    total = sum(len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in new.values())
    assert packed.agg(F.sum("length")).first()[0] == total


def test_run_is_the_stages_in_order(spark, tables):
    got = C.run(spark, DATA)
    assert got.columns == tables[-1].columns
    assert sorted(map(tuple, got.select("doc_id", "start", "doc_tokens").where("start = 0").collect())) == sorted(map(tuple, tables[-1].select("doc_id", "start", "doc_tokens").where("start = 0").collect()))


def test_awkward_documents(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "token=abcdef1", "en", "s", 13), (3, "token=abcdef1", "en", "s", 13), (3, "token=abcdef1", "en", "s", 13)], "doc_id long, text string, lang string, source string, n_chars long")
    out = docs
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, out, DATA)
        assert out.columns == COLUMNS
    assert sorted(map(str, map(tuple, out.select("doc_id", "text", "n_chars").collect()))) == sorted(map(str, [(1, None, None), (2, "", 0), (3, "[secret]", 8)]))
    assert C.STAGES[-1][1](spark, out, DATA).count() >= 3
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs.limit(0), DATA).collect() == []


def test_rows_that_share_an_id_are_decided_each(spark):
    """Repeated and null ids: each row goes or stays by its own text."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").where("length(text) > 80").first().text
    text = lambda k: " ".join(f"word{k}x{j}" for j in range(30))
    rows = [(1, text(1)), (1, text(2)), (2, text(1)), (None, text(2)), (None, text(3)), (None, text(4)), (5, text(4)), (None, text(5)), (None, text(5))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    single = sorted(map(str, map(tuple, C.near_dedup(spark, docs, DATA).select("doc_id", "text").collect())))
    assert single == sorted(map(str, [(1, text(1)), (1, text(2)), (None, text(3)), (5, text(4)), (None, text(5))]))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [(1, text(1)), (1, item), (None, item), (None, text(2))]], schema)
    apart = sorted(map(str, map(tuple, C.decontamination(spark, docs, DATA).select("doc_id", "text").collect())))
    assert apart == sorted(map(str, [(1, text(1)), (None, text(2))]))


def test_run_leaves_only_the_last_table(spark, tmp_path, monkeypatch):
    from verbspark.llm import session

    for module in (C, session):
        monkeypatch.setattr(module, "shared_folder", lambda _: str(tmp_path))
    C.run(spark, "/root/testdata/sf0.001").count()
    assert [p.name for folder in tmp_path.iterdir() for p in folder.iterdir()] == ["4-packing"]
