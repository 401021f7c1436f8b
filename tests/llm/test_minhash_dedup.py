"""Near-duplicate groups against brute force over all pairs that share a shingle."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from verbspark.llm import components
from verbspark.llm import minhash_dedup as M
from verbspark.llm.components import connected_components
from verbspark.llm.session import checkpointed

DATA = "/root/testdata/sf0.01"


def brute(rows, size=5, per_cent=75):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owners = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            owners[x].append(i)
    shared = defaultdict(int)
    for own in owners.values():
        for k, a in enumerate(own):
            for b in own[k + 1 :]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= per_cent * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    expected = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert result(M.near_duplicates(docs)) == expected


def test_many_close_texts_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(M, "TILE_ROWS", 8)
    rng = random.Random(1)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(90):
        own = list(base)
        for k in rng.sample(range(120), rng.randint(0, 9)):
            own[k] = f"x{i}.{k}"
        rows.append((i, " ".join(own).upper() if i % 7 == 0 else " \t".join(own)))
    assert result(M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "ONE two"), (6, "one two three"), (7, "a b c d e"), (8, "a b c d E"), (9, "é É"), (10, "É É"), (11, "long " * 60000), (12, "LONG " * 60001)]
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, id string, component long")
    assert result(M.near_duplicates(df)) == brute(rows)


def test_null_and_repeated_ids_and_no_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)]
    got = [tuple(r) for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(None, 2, None, True), (3, 2, 3, True), (3, 2, 3, True), (None, 0, None, True)], key=str)
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_keys_find_all_pairs_within_the_guaranteed_distance():
    rng = np.random.default_rng(3)
    n = M.CHUNKS * M.WIDTH
    radius = M.CHUNKS * (M.ERRORS + 1) - 1
    a = rng.integers(0, 1 << 16, (200, n)).astype("<u2")
    b = a.copy()
    for row in b:
        row[rng.choice(n, radius, replace=False)] ^= 1
    assert (M.chunk_keys(a) == M.chunk_keys(b)).any(axis=1).all()


def test_shared_counts():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 90)).astype(np.uint64)) for _ in range(40)]
    got = M.shared_counts(sets, 25)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(25) for j in range(40) if i != j)


@pytest.mark.parametrize("n", [1, 60])
def test_components_of_a_chain(spark, n):
    links = spark.createDataFrame([(k + 1, k) for k in range(n)] + [(1, 1), (None, 3), (500, 501)], "a long, b long")
    got = {r.id: r.label for r in connected_components(links).collect()}
    assert got == {k: 0 for k in range(n + 1)} | {500: 500, 501: 500} | ({1: 0} if n else {})


def test_links_that_differ_in_every_reading(spark):
    def tree(batches):
        import random

        import pyarrow as pa

        for _ in batches:
            order = list(range(80))
            random.SystemRandom().shuffle(order)
            yield pa.RecordBatch.from_arrays([pa.array(order[1:], pa.int64()), pa.array(order[:-1], pa.int64())], names=["a", "b"])

    links = spark.range(1, numPartitions=1).mapInArrow(tree, "a long, b long")
    assert {r.id: r.label for r in connected_components(links).collect()} == {k: 0 for k in range(80)}


@pytest.mark.parametrize("n, rounds", [(80, 8), (10_000, 14)])
def test_a_shuffled_path_takes_few_rounds(spark, monkeypatch, n, rounds):
    made = []
    monkeypatch.setattr(components, "checkpointed", lambda df: made.append(None) or checkpointed(df))
    order = list(range(n))
    random.Random(n).shuffle(order)
    links = spark.createDataFrame(list(zip(order[1:], order[:-1])), "a long, b long").repartition(4)
    labels = connected_components(links)
    assert (labels.count(), labels.where("label != 0").count()) == (n, 0)
    assert len(made) <= 2 + 3 * rounds  # the links, three tables a round, and the last round's first


def test_star_of_many_links(spark):
    labels = connected_components(spark.range(1, 50_001).selectExpr("id AS a", "50001 - id % 2 * 50001 AS b"))
    assert [tuple(r) for r in labels.groupBy("label").count().orderBy("label").collect()] == [(0, 25_001), (2, 25_001)]


def test_a_long_chain_of_near_copies(spark):
    """Each version changes the one before a little, so the first and the last have nothing in common."""
    words = [f"w{k}" for k in range(460)]
    order = list(range(150))
    random.Random(7).shuffle(order)
    rows = [(i, " ".join(words[2 * i : 2 * i + 60])) for i in order] + [(1000, "something else of a few words")]
    got = result(M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert got == {i: (56, 0, i == 0) for i in range(150)} | {1000: (2, 1000, True)}


def test_tiles_of_a_hot_centre_are_linear(spark, monkeypatch):
    """Copies that are near their centre meet it alone; the few that are not meet all tiles."""
    monkeypatch.setattr(M, "TILE_ROWS", 10)
    near = spark.createDataFrame([(0, k, 50) for k in range(1000)], "centre long, node long, n long")
    extent = near.groupBy("centre").agg(M._tiles().alias("tiles"))
    assert M._own_tiles(near, extent).count() == 999 + 100
    labels = spark.createDataFrame([(k, 0) for k in range(990)], "id long, label long")
    apart = M._apart(near, labels)
    assert apart.where("free").count() == 10
    assert M._other_tiles(apart).count() == 990 + 10 * (1 + 99)
