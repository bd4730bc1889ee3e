from __future__ import annotations

import numpy as np
import pyarrow.dataset as ds
import pytest

from orderlens.llm import routed

SCHEMA = "vec_id long, embedding array<float>, label int, id string, part int, score double"


def brute(rows, every=20, k=20):
    """rows: (id, vector), all taking part; the best row stands for an id."""
    out = {}
    for query in sorted({i for i, _ in rows if i % every == 0}):
        mine = [np.array(v, np.float64) for i, v in rows if i == query]
        best = {}
        for i, v in rows:
            if i != query:
                score = max(float((np.array(v, np.float64) * m).sum()) for m in mine)
                best[i] = max(score, best.get(i, -np.inf))
        out[query] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        found = out.setdefault(r.query_id, [])
        assert r.rank == len(found) + 1
        found.append((r.vec_id, r.score))
    return out


def same(found, want):
    assert found.keys() == want.keys()
    for query, rows in want.items():
        assert [i for i, _ in found[query]] == [i for i, _ in rows]
        assert np.allclose([s for _, s in found[query]], [s for _, s in rows], rtol=1e-12, atol=0)


def clustered(rows=6000, dim=16, clusters=40, seed=3):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(clusters, dim))
    vectors = centres[random.integers(0, clusters, rows)] + 0.15 * random.normal(size=(rows, dim))
    return vectors.astype(np.float32)


def frame(spark, vectors, first=0):
    rows = [(first + i, v.tolist(), 0, "x", 7, 0.5) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_partition_is_balanced_and_cuts_few_links():
    vectors = clustered(1024, clusters=8).astype(np.float64)
    source, target = routed.neighbour_links(vectors)
    part = routed.balanced_partition(len(vectors), source, target, 8)
    assert np.bincount(part).tolist() == [128] * 8
    random = np.random.default_rng(0).permutation(part)
    assert (part[source] != part[target]).mean() < 0.5 * (random[source] != random[target]).mean()


def test_router_learns_the_partitions():
    vectors = clustered(2048).astype(np.float64)
    source, target = routed.neighbour_links(vectors)
    part = routed.balanced_partition(len(vectors), source, target, 8)
    route = routed.routes(routed.fit(vectors, 8), vectors)
    rank = np.argsort(route, axis=1)[source, part[target]]
    assert (rank < 2).mean() > 0.9
    assert (routed.fit(vectors, 8).out == routed.fit(vectors, 8).out).all()


def test_clustered_vectors_probe_few_partitions(spark):
    vectors = clustered()
    df = frame(spark, vectors)
    rows = routed.usable_vectors(df, "vec_id", "embedding")
    queries = rows.where("id % 20 = 0")
    index = routed.build_index(rows, queries, partition_rows=256)
    assert len(index.sizes) >= 16 and sum(index.sizes) == len(vectors)
    assert index.probes <= len(index.sizes) // 3 and index.recall >= routed.RECALL
    found = lists(routed.search(queries, index, block_rows=100, block_queries=30))
    want = brute(list(enumerate(vectors.tolist())))
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in rows}) for q, rows in want.items())
    assert hits / (20 * len(want)) >= 0.9
    assert all(len(rows) == 20 for rows in found.values())


def test_vectors_without_structure_reach_the_recall(spark):
    random = np.random.default_rng(5)
    vectors = random.normal(size=(4000, 24)).astype(np.float32)
    rows = routed.usable_vectors(frame(spark, vectors), "vec_id", "embedding")
    queries = rows.where("id % 20 = 0")
    index = routed.build_index(rows, queries, partition_rows=500)
    found, want = lists(routed.search(queries, index)), brute(list(enumerate(vectors.tolist())))
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in rows}) for q, rows in want.items())
    assert hits / (20 * len(want)) >= 0.9


def test_whole_probing_is_exact(spark):
    """With every partition probed, routes, blocks and merging lose nothing."""
    vectors = clustered(1500)
    rows = routed.usable_vectors(frame(spark, vectors), "vec_id", "embedding")
    queries = rows.where("id % 20 = 0")
    index = routed.build_index(rows, queries, recall=1.0, partition_rows=128)
    whole = routed.Index(index.rows, index.router, index.sizes, len(index.sizes), 1.0)
    same(lists(routed.search(queries, whole, block_rows=50, block_queries=7)), brute(list(enumerate(vectors.tolist()))))


def test_given_vectors(spark):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    found = lists(routed.nearest_neighbours(spark.read.parquet(path)))
    given = ds.dataset(path).to_table().to_pylist()
    same(found, brute([(r["vec_id"], r["embedding"]) for r in given]))


def test_odd_rows(spark):
    nan = float("nan")
    vector = lambda i: [float((i * 5 + k * 3) % 7 - 3) for k in range(6)]
    good = [(i, vector(i)) for i in range(70)]
    good += [(40, vector(1)), (40, vector(40)), (5, vector(6)), (5, vector(5)), (-20, vector(2))]  # ids twice
    good += [(1000 + i, vector(3)) for i in range(60)]  # equal vectors: ties follow the id
    bad = [(80, None), (100, [0.0] * 6), (120, [None] * 6), (140, [nan] * 6), (160, [1.0]), (None, vector(1)), (180, [])]
    df = spark.createDataFrame([(i, v, None, "x", 3, 0.5) for i, v in [*good, *bad]], SCHEMA).repartition(4)
    same(lists(routed.nearest_neighbours(df)), brute(good))


@pytest.mark.parametrize("rows", [[], [(20, [1.0, 2.0])], [(20, [1.0, 2.0]), (1, [0.5, 0.5])], [(1, [1.0]), (2, [2.0])]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame([(i, v, 0, "x", 3, 0.5) for i, v in rows], SCHEMA)
    found = routed.nearest_neighbours(df)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert lists(found) == ({20: [(1, 1.5)]} if len(rows) == 2 and rows[0][0] == 20 else {})
