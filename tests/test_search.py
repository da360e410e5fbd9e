import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trovescan.operators import search
from trovescan.operators.nearest import Nearest, matrix
from trovescan.session import scratch_path


def brute(queries, vectors, k):
    """Ids of the k nearest, lower id first among equals."""
    out = []
    for q in queries.astype(np.float64):
        gaps = q[None, :] - vectors.astype(np.float64)
        scores = np.zeros(len(vectors))
        for d in range(gaps.shape[1]):
            scores += gaps[:, d] ** 2
        out.append(sorted(range(len(vectors)), key=lambda i: (scores[i], i))[:k])
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(600, 8)).astype(np.float32)
    vectors[100:300] = vectors[100]  # a third of all rows are copies of one
    return vectors[::7].copy(), vectors


def frames(spark, queries, vectors):
    q = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(queries)], "query_id string, embedding array<float>")
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "faiss_id bigint, embedding array<float>")
    return q, v.repartition(3)


def ids(found, n):
    got = [[] for _ in range(n)]
    for r in found.orderBy("query_id", "rank").collect():
        got[int(r["query_id"])].append(r["faiss_id"])
    return got


@pytest.mark.parametrize("batch", [1, 37, 600])
@pytest.mark.parametrize("k", [1, 10, 700])
def test_kernel_in_batches(data, batch, k):
    queries, vectors = data
    state = Nearest(queries, k)
    for at in range(0, len(vectors), batch):
        part = vectors[at : at + batch]
        state.offer(np.arange(at, at + len(part)), part)
    row, found, _ = state.hits()
    got = [found[row == i].tolist() for i in range(len(queries))]
    assert got == brute(queries, vectors, k)


@pytest.mark.parametrize("sizes", [(), (0, 1000)])
def test_exact(spark, data, sizes):
    q, v = frames(spark, *data)
    assert ids(search.knn_exact(q, v, 10, *sizes), len(data[0])) == brute(*data, 10)


@pytest.mark.parametrize("sizes", [(), (0, 1000)])
def test_clusters(spark, data, sizes):
    q, v = frames(spark, *data)
    index = search.build_clusters(v, cells=5)
    found = search.knn_clusters(q, index, 10, 1, True, *sizes)
    assert ids(found, len(data[0])) == brute(*data, 10)


@pytest.mark.parametrize("sizes", [(), (0, 1000)])
def test_hashed(spark, data, sizes):
    q, v = frames(spark, *data)
    index = search.build_hashed(v, dim=8, tables=3, width=0.5)
    found = search.knn_hashed(q, index, 10, True, *sizes)
    assert ids(found, len(data[0])) == brute(*data, 10)


def test_more_neighbours_than_vectors(spark, data):
    q, v = frames(spark, data[0][:3], data[1][:20])
    index = search.build_clusters(v, cells=3)
    for found in (search.knn_exact(q, v, 50), search.knn_clusters(q, index, 50, 1)):
        assert ids(found, 3) == brute(data[0][:3], data[1][:20], 50)


def test_no_queries(spark, data):
    q, v = frames(spark, *data)
    assert search.knn_exact(q.where("query_id = 'none'"), v, 5).count() == 0


def test_vectors_are_not_shuffled_for_small_query_sets(spark, data, capsys):
    q, v = frames(spark, *data)
    stored = search.materialize(v, "test-vectors")
    search.knn_exact(q, stored, 5).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "CartesianProduct" not in plan
    assert plan.count("WindowGroupLimit") == 2 and "NestedLoop" not in plan


def test_only_probed_tiles_of_a_stored_index_are_asked_for(spark, data, capsys):
    q, v = frames(spark, *data)
    path = scratch_path(spark, "test-clusters")
    search.write_clusters(v, path, cells=5, tile_rows=20)
    index = search.read_clusters(spark, path)
    search.knn_clusters(q.where("query_id = '0'"), index, 10, probes=1, complete=False).explain("formatted")
    pushed = [x for x in capsys.readouterr().out.splitlines() if x.startswith("PushedFilters")]
    assert any("In(cell" in x or "EqualTo(cell" in x for x in pushed), pushed
    assert index.vectors.count() == len(data[1]) == index.rows.sum() and index.rows.max() <= 20


def clustered(n=1200, centres=12, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, 8)) * 20
    return (middle[rng.integers(0, centres, n)] + rng.normal(size=(n, 8))).astype(np.float32)


def test_most_tiles_are_not_searched_on_clustered_data(spark, monkeypatch):
    vectors = clustered()
    queries = vectors[::9].copy()
    q, v = frames(spark, queries, vectors)
    asked = []
    real = search._tile_search

    def watched(df, *rest):
        asked.append(df.select("query_id", "cells").collect())
        return real(df, *rest)

    monkeypatch.setattr(search, "_tile_search", watched)
    indexes = []
    made = search.build_clusters

    def build(*args, **kw):
        indexes.append(made(*args, **kw))
        return indexes[-1]

    monkeypatch.setattr(search, "build_clusters", build)
    found = search.knn_exact(q, v, 10, 0, 32 * 50)
    assert ids(found, len(queries)) == brute(queries, vectors, 10)
    tiles = len(indexes[0].tiles)
    pairs = sum(len(r["cells"]) for step in asked for r in step)
    assert tiles >= 24 and pairs < 0.25 * tiles * len(queries)


@pytest.mark.parametrize("scale", [1.0, 3000.0])
def test_tile_bounds_hold_for_long_vectors(spark, scale):
    vectors = (clustered(500, 3, 4) * scale + np.float32(50 * scale)).astype(np.float32)
    q, v = frames(spark, vectors[:30], vectors)
    index = search.build_clusters(v, cells=4, tile_rows=16)
    assert ids(search.knn_clusters(q, index, 3, 1), 30) == brute(vectors[:30], vectors, 3)


def test_appended_vectors_are_found(spark, data):
    queries, vectors = data
    q, v = frames(spark, queries, vectors)
    path = scratch_path(spark, "test-clusters")
    search.write_clusters(v.where("faiss_id < 250"), path, cells=4, tile_rows=30)
    before = search.cluster_growth(spark, path).collect()
    assert [(r["generation"], r["rows"], r["refit"]) for r in before] == [(0, 250, False)]
    for low, high in ((250, 300), (300, 300), (300, 600)):
        search.append_clusters(v.where(f"faiss_id >= {low} and faiss_id < {high}"), path, 30)
    index = search.read_clusters(spark, path)
    assert ids(search.knn_clusters(q, index, 10, 1), len(queries)) == brute(queries, vectors, 10)
    growth = {r["generation"]: r for r in search.cluster_growth(spark, path).collect()}
    assert sum(r["rows"] for r in growth.values()) == 600 and growth[max(growth)]["refit"]


def test_a_failed_append_is_not_seen(spark, data):
    q, v = frames(spark, *data)
    path = scratch_path(spark, "test-clusters")
    search.write_clusters(v.where("faiss_id < 250"), path, cells=4)
    v.where("faiss_id >= 250").selectExpr("faiss_id", "embedding", "0L AS centre", "0D AS gap", "1L << 44 AS cell").write.parquet(
        f"{path}/vectors/generation=1"
    )
    assert search.read_clusters(spark, path).vectors.count() == 250
    search.append_clusters(v.where("faiss_id >= 590"), path)
    assert search.read_clusters(spark, path).vectors.count() == 260


def test_buckets_within_reach_are_the_occupied_ones(spark, data):
    q, v = frames(spark, *data)
    index = search.build_hashed(v, dim=8, tables=2, width=0.05)
    held = sorted(r["cell"] for r in index.occupied.collect())
    rng = np.random.default_rng(2)
    asked = [(str(i), int(rng.integers(held[0] - 3, held[-1] + 3)), None if i % 5 == 0 else float(rng.random() * 2)) for i in range(60)]
    df = spark.createDataFrame(asked, "query_id string, own bigint, bound double")
    for bins in (1, 7, 1024):
        found = search.buckets_within_reach(df, index, bins)
        assert "embedding" not in found._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["query_id"], r["cell"]) for r in found.collect())
        reach = lambda b: (np.sqrt(b) * (1 + 1e-6) + 1e-6) / 0.05
        want = [
            (name, c) for name, own, bound in asked for c in held
            if c != own and (bound is None or np.floor(own - reach(bound)) <= c <= np.ceil(own + reach(bound)))
        ]
        assert got == sorted(want)


def test_a_vector_offered_twice_counts_once(data):
    queries, vectors = data
    state = Nearest(queries, 10, distinct=True)
    rows = np.arange(len(queries))
    for part in (rows[::2], rows, rows[1::2]):
        state.offer(np.arange(len(vectors)), vectors, part)
    row, found, _ = state.hits()
    assert [found[row == i].tolist() for i in range(len(queries))] == brute(queries, vectors, 10)


def test_only_probed_buckets_of_a_stored_index_are_asked_for(spark, data, capsys):
    q, v = frames(spark, *data)
    path = scratch_path(spark, "test-hashed")
    search.write_hashed(v, path, dim=8, tables=2, width=0.5)
    index = search.read_hashed(spark, path)
    search.knn_hashed(q.where("query_id = '0'"), index, 10, complete=False).explain("formatted")
    pushed = [x for x in capsys.readouterr().out.splitlines() if x.startswith("PushedFilters")]
    assert any("In(cell" in x or "EqualTo(cell" in x for x in pushed), pushed
    compared = {r["query_id"]: r["compared"] for r in search.compared_in_tables(q, index).collect()}
    assert len(compared) == len(data[0]) and max(compared.values()) <= 2 * len(data[1])


@pytest.mark.parametrize("bad", [[float("nan")] * 4, [1.0, None, 0.0, 0.0], [1.0, 2.0, 3.0], None])
def test_bad_vectors_fail_loudly(bad):
    rows = pa.array([[1.0, 0.0, 0.0, 0.0], bad, [1.0, 2.0, 3.0, 4.0]], pa.list_(pa.float32()))
    with pytest.raises(ValueError, match="vectors must"):
        matrix(rows)
    assert matrix(rows.take(pa.array([0, 2]))).shape == (2, 4)


def test_a_query_is_copied_by_bundles_and_not_by_cells(spark, data):
    queries, vectors = data
    q, v = frames(spark, queries, vectors)
    cells = F.sequence(F.lit(0).cast("bigint"), F.lit(49).cast("bigint"))
    asked = q.select("query_id", "embedding", cells.alias("cells"), F.lit(None).cast("double").alias("bound"))
    held = v.select(F.when(F.col("faiss_id") < 100, F.lit(7)).otherwise(F.pmod("faiss_id", F.lit(50))).cast("bigint").alias("cell"), "*")
    found = search.search_cells(asked, held, 10, 0, 32 * 50)
    assert found.count() <= len(queries) * 10 * search.SPREAD
    assert ids(search.top_hits(found, 10), len(queries)) == brute(queries, vectors, 10)


def test_kept_hits_leave_in_bounded_batches():
    n, k = 30_000, 11
    state = Nearest(np.zeros((n, 2), np.float32), k)
    state.offer(np.arange(k), np.zeros((k, 2), np.float32))
    state.scores[::7, -2:] = np.inf
    got = list(search._hit_batches(pa.array([f"q{i}" for i in range(n)]), state))
    assert len(got) > 2 and max(b.num_rows for b in got) < n * k / 2
    row, ids, scores = state.hits()
    want = list(zip([f"q{i}" for i in row], ids.tolist(), scores.tolist(), strict=True))
    rows = [tuple(r.values()) for b in got for r in b.to_pylist()]
    assert rows == want
    empty = Nearest(np.zeros((0, 0), np.float32), k)
    assert sum(b.num_rows for b in search._hit_batches(pa.array([], pa.string()), empty)) == 0
