import numpy as np
import pyarrow as pa
import pytest
from llm_cases import groups

from pageflow.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int"


def _expected(rows, cosine=0.9):
    units = {}
    for i, v, _ in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = np.array(v, np.float32).astype(float)
            units[i] = v / np.linalg.norm(v)
    links = [
        (a, b)
        for a in units
        for b in units
        if a < b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= cosine
    ]
    root = groups(links, [i for i, *_ in rows])
    degree = {i: 0 for i, *_ in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return {i: (degree[i], root[i], root[i] == i) for i in degree}


def _found(spark, rows, settings=embeddings.VectorSettings()):
    found = embeddings.vector_links(spark.createDataFrame(rows, SCHEMA), settings).collect()
    assert len(found) == len(rows)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found}


def _cloud(seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, 12))
    rows = [v for v in base]
    for v in base[:20]:
        rows += [v + rng.normal(size=12) * s for s in (0.05, 0.15, 0.25, 0.3)]
    rows += [base[0] + rng.normal(size=12) * 0.02 for _ in range(150)]
    rows += [base[1]] * 40 + [base[2] * 3.5] * 5
    order = rng.permutation(len(rows))
    return [(i, [float(x) for x in rows[k]], 0) for i, k in enumerate(order)]


@pytest.mark.parametrize("settings", [embeddings.VectorSettings(), embeddings.VectorSettings(shard_rows=40, block=16)])
def test_links_equal_brute_force(spark, settings):
    rows = _cloud()
    expected, found = _expected(rows), _found(spark, rows, settings)
    wrong = [i for i in expected if expected[i] != found[i]]
    links = sum(n for n, *_ in expected.values())
    assert sum(found[i][0] for i in found) >= 0.95 * links
    assert all(found[i][0] <= expected[i][0] for i in found)
    assert len(wrong) <= 0.02 * len(rows)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, None, 0), (1, [], 0), (2, [0.0, 0.0], 0), (3, [1.0, nan], 0), (4, [1.0, inf], 0), (5, [1.0, None], 0)]
    rows += [(6, [1.0, 0.0], 0), (7, [2.0, 0.0], 0), (8, [1.0, 0.0, 0.0], 0), (9, [-1.0, 0.0], 0), (10, [1.0, 0.0], 1)]
    assert _found(spark, rows) == _expected(rows)
    assert embeddings.vector_links(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_link(spark):
    rows = [(4, [1.0, 2.0], 0)] * 2 + [(None, [1.0, 2.0], 0)]
    found = embeddings.vector_links(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in found} == {(4, 2, 4, True), (None, 2, 4, False)}


def test_search_follows_the_graph():
    rng = np.random.default_rng(0)
    units = rng.normal(size=(300, 6))
    units /= np.linalg.norm(units, axis=1)[:, None]
    lists = embeddings.pruned_graph(units, 16, 1.2)
    graph = np.full((300, 16), -1)
    for i, near in enumerate(lists):
        graph[i, : len(near)] = near
    queries = np.arange(300)
    found = embeddings.range_search(units, graph, 0, queries, np.full(300, 0.8), 32)
    true = units @ units.T >= 0.8
    assert sum(map(len, found)) >= 0.95 * true.sum()
    assert all(true[i, f].all() for i, f in enumerate(found))


def _loose_group(count, others=300, size=64, seed=5):
    """Vectors of which nearly all link pairwise, at cosines from 0.9 to 0.95, and some that link with nothing."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=size)
    noise = rng.normal(size=(count, size))
    noise -= np.outer(noise @ centre, centre) / (centre @ centre)
    noise *= np.linalg.norm(centre) * np.sqrt(1 / 0.93 - 1) / np.linalg.norm(noise, axis=1)[:, None]
    vectors = np.concatenate([centre + noise, rng.normal(size=(others, size))]).astype(np.float32)
    return vectors[rng.permutation(len(vectors))]


def test_large_loose_group_is_found_whole(spark):
    vectors = _loose_group(20_000)
    table = pa.table({"vec_id": np.arange(len(vectors)), "embedding": pa.array(list(vectors), pa.list_(pa.float32()))})
    found = embeddings.vector_links(spark.createDataFrame(table)).toPandas().sort_values("vec_id")
    units = vectors.astype(float)
    units /= np.linalg.norm(units, axis=1)[:, None]
    degree = np.concatenate([(units[k : k + 1000] @ units.T >= 0.9).sum(axis=1) for k in range(0, len(units), 1000)]) - 1
    assert (found.n_links.to_numpy() <= degree).all()
    assert found.n_links.sum() >= 0.95 * degree.sum()
    linked = degree > 0
    assert (found.component_id[linked] == np.flatnonzero(linked)[0]).all()
    assert (found.component_id.to_numpy()[~linked] == np.flatnonzero(~linked)).all()


def test_splits_count_each_pair_once(spark):
    rows = _cloud()
    settings = embeddings.VectorSettings(shard_rows=40, block=16, max_shard_rows=30, overlap=8)
    assert _found(spark, rows, settings) == _expected(rows)


def test_audit_draws_by_vectors_and_counts_links(spark):
    # 2,000 vectors of one cell and 20,000 single leaders: evenly drawn leaders would hardly ever meet the cell
    lone = [(k, [1.0, float(k)], 1, k) for k in range(20_000)]
    hot = [(100_000 + k, [-1.0 - k / 1e6, 0.0], 10, 100_000) for k in range(2_000)]
    members = spark.createDataFrame(lone + hot, "node long, vector array<double>, copies long, cell long")
    drawn = embeddings._audited(members, embeddings.VectorSettings())
    assert 40 <= drawn.where("node >= 100000").count() <= 90 and drawn.count() <= 256

    rows = [(k, [1.0, 0.0], 5, 0) for k in range(20)] + [(50, [-1.0, 0.0], 1, 50), (51, [-1.0, 0.01], 1, 51)]
    members = spark.createDataFrame(rows, members.schema)
    whole = [(k, 99) for k in range(20)] + [(50, 1), (51, 1)]
    for counted, least, most in (
        (whole, 1.0, 1.0),
        ([(k, 4 if k < 20 else 1) for k, _ in whole], 0.0, 0.3),
        ([(k, n if k < 20 else 0) for k, n in whole], 0.0, 0.92),
    ):
        table = spark.createDataFrame(counted, "node long, n_links long")
        assert least <= embeddings.audited_recall(members, table, embeddings.VectorSettings()) <= most
