"""Near-duplicate vectors against brute force, and the edges of its inputs."""

import numpy as np
import pytest

import tarn.llm.catalogue as catalogue
from tarn.llm import near_vectors
from tarn.operators.graph import Graph


def unit(n, d, seed):
    m = np.random.default_rng(seed).normal(size=(n, d))
    return m / np.linalg.norm(m, axis=1)[:, None]


def brute(rows, threshold=0.95):
    """``id -> (n_links, component)`` and the linked pairs of rows (id, vector), by all cosines."""
    ids = [i for i, _ in rows]
    m = np.array([v for _, v in rows], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    hit = m @ m.T >= threshold
    np.fill_diagonal(hit, False)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in np.argwhere(hit).tolist():
        x, y = sorted((find(a), find(b)), key=lambda i: ids[i])
        root[y] = x
    return {ids[i]: (int(hit[i].sum()), ids[find(i)]) for i in range(len(ids))}


def planted(n=3000, d=32, seed=3):
    """Random vectors; pairs, chains and one group of a third of all that lie close together; repeats."""
    r = np.random.default_rng(seed)
    m = unit(n, d, seed)
    m[: n // 3] = m[0] + 0.1 * unit(n // 3, d, 4)
    for a in range(n // 3, n // 2, 2):
        m[a + 1] = m[a] + r.uniform(0.01, 0.4) * unit(1, d, a)[0]
    m[n // 2 : n // 2 + 40] = m[-1]
    return m[r.permutation(n)]


def test_links_and_components_as_by_brute_force(spark):
    m = planted().astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_vectors(df, shard_rows=700).collect()}
    assert set(got) == set(want)
    links = sum(n for n, _ in want.values())
    assert links > 900_000
    # None below the threshold, and nearly all above it.
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.99 * links
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)
    again = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_vectors(df.repartition(3), shard_rows=700).collect()}
    assert again == got


def test_query(spark, sf_dir):
    got = catalogue.op12_embedding_dedup(spark, sf_dir).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_edges(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.96, 0.28, 0.0]
    inf, nan = float("inf"), float("nan")
    rows = [(5, a), (3, a), (9, [2.0, 0.0, 0.0]), (None, a), (7, c), (20, b), (21, [-0.0, 1e300, 0.0]), (22, [0.0, 1e-300, 0.0]), (30, None), (31, []), (32, [0.0] * 3),
            (33, [1.0, None, 0.0]), (34, [1.0, nan, 0.0]), (35, [inf, 0.0, 0.0]), (40, [1.0, 0.0]), (41, [1.0, 0.0, 0.0, 0.0]), (50, [-1.0, 0.0, 0.0]), (60, [0.0, 0.0, 1.0]), (60, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, shard int, first string")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(df).collect()]
    named = {r[0]: r[1:] for r in got}
    assert len(got) == len(rows)
    assert named[3] == (4, 3, True) and named[5] == (4, 3, False) and named[9] == (4, 3, False)
    assert named[None] == (4, 3, False) and named[7] == (4, 3, False)
    assert named[20] == (2, 20, True) and named[21] == (2, 20, False) and named[22] == (2, 20, False)
    assert all(named[i] == (0, i, True) for i in (30, 31, 32, 33, 34, 35, 40, 41, 50))
    assert [r[1:] for r in got if r[0] == 60] == [(1, 60, True)] * 2
    assert near_vectors.near_vectors(df.limit(0)).count() == 0
    lonely = near_vectors.near_vectors(df.filter("vec_id is null").unionByName(df.filter("vec_id is null")))
    assert [tuple(r) for r in lonely.collect()] == [(None, 1, None, True)] * 2


def test_just_at_the_threshold(spark):
    # 3-4-5 triangles: 0.96 and 0.936 are the cosines.
    rows = [(1, [1.0, 0.0]), (2, [0.96, 0.28]), (3, [0.936, 0.352])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in near_vectors.near_vectors(df, threshold=0.96).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("n", [1, 31, 2000])
def test_graph_finds_stored_vectors(n):
    m = unit(n, 24, 1)
    graph = Graph(24, m=8, ef_construction=50)
    graph.add(m)
    nodes, d = graph.search(m, 3, 32)
    assert (nodes[:, 0] == np.arange(n)).mean() > 0.99 and np.allclose(d[nodes[:, 0] == np.arange(n), 0], 0, atol=1e-5)
    assert (nodes[:, 1:] == -1).all() if n == 1 else True


def test_audit_widens_the_beam():
    m = unit(4000, 24, 2)
    graph = Graph(24, m=4, ef_construction=8)
    graph.add(m, own=2)
    narrow, wide = (near_vectors.audited(graph, m, 4, 0.95, 200, r, 0) for r in (0.3, 0.97))
    assert narrow and (wide == 0 or wide > narrow)
    # Where no beam would do, the shard is held against as a whole.
    graph.links = [np.full_like(x, -1) for x in graph.links]
    assert near_vectors.audited(graph, m, 4, 0.95, 200, 0.97, 0) == 0
