import json
import math
import random
import re
from collections import Counter
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trovescan.functions.choice import lenient, strict
from trovescan.operators import hits as hits_of
from trovescan.operators import ids, metrics, rerank, selection
from trovescan.operators.chunks import chunk_count, chunk_documents
from trovescan.operators.embed import hash_embed
from trovescan.operators.quantize import decode, encode
from trovescan.plans import index_build, views
from trovescan.plans.catalog import QUERIES
from trovescan.session import BATCH_BYTES, materialize, scratch_path
from trovescan.sources import pages, stores, tables, versions


def docs(spark, n, first=0):
    rows = [(f"d{i:04d}", f"t{i}", " ".join(["w"] * (i % 7)), "") for i in range(first, first + n)]
    return spark.createDataFrame(rows, "id string, title string, text string, url string")


def test_python_steps_of_a_stored_table_get_bounded_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    wide = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 5000).alias("text"))
    got = materialize(wide.mapInArrow(sizes, "n long, size long"), "sizes").agg(F.sum("n"), F.max("size")).first()
    assert got[0] == 6000 and got[1] < 1.1 * BATCH_BYTES
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    assert spark.conf.get(limit, None) is None
    spark.conf.set(limit, "1m")
    try:
        got = materialize(wide.mapInArrow(sizes, "n long, size long"), "sizes").agg(F.sum("n"), F.max("size")).first()
        assert got[0] == 6000 and got[1] < 1.1 * (1 << 20) and spark.conf.get(limit) == "1m"
    finally:
        spark.conf.unset(limit)


# --- ids, shards, runs --------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 100])
def test_ids_are_gapless_and_ordered(spark, n):
    got = ids.assign_ids(docs(spark, n).repartition(5), ["id"], 41).orderBy("faiss_id").collect()
    assert [(r["faiss_id"], r["id"]) for r in got] == [(41 + i, f"d{i:04d}") for i in range(n)]


@pytest.mark.parametrize("n,sizes", [(0, []), (10, [10]), (11, [10, 1]), (20, [10, 10])])
def test_shards(spark, n, sizes):
    numbered = spark.range(5, 5 + n).select(F.col("id").alias("faiss_id"), F.lit("d").alias("doc_id"))
    sharded = ids.assign_shards(numbered, 5, 10, existing=2)
    shards = ids.manifest(sharded, "m", 4)
    rows = shards.orderBy("first_id").collect()
    assert [r["count"] for r in rows] == sizes
    assert [r["shard"] for r in rows] == [f"shard_{i + 3:04d}" for i in range(len(sizes))]
    state = ids.index_state(shards, 5).first()
    assert (state["next_global_id"], state["shards"]) == (5 + n, len(sizes))


def embed4(chunks):
    return hash_embed(chunks, "text", 4)


def shard_rows(manifest):
    return [tuple(r) for r in manifest.orderBy("first_id").collect()]


def test_append_runs(spark):
    path = scratch_path(spark, "test-index")
    args = dict(rows_per_shard=10, size=2, stride=1)
    first = shard_rows(index_build.append_chunks(docs(spark, 10), path, embed4, "m", 4, **args))
    again = shard_rows(index_build.append_chunks(docs(spark, 10), path, embed4, "m", 4, **args))
    assert first == again
    more = shard_rows(index_build.append_chunks(docs(spark, 20), path, embed4, "m", 4, **args))
    assert more[: len(first)] == first
    got = [r["faiss_id"] for r in index_build.read_index(spark, path).orderBy("faiss_id").collect()]
    assert got == list(range(1, more[-1][4]))
    assert index_build.read_index_vectors(spark, path).count() == len(got)
    with pytest.raises(ValueError):
        index_build.append_chunks(docs(spark, 1), path, embed4, "other", 4)
    whole = shard_rows(index_build.append_chunks(docs(spark, 20), path, embed4, "m", 4, resume=False, **args))
    assert whole[-1][4] - 1 == 2 * len(got)


def test_shards_of_a_failed_run_are_not_listed(spark):
    path, args = scratch_path(spark, "test-index"), dict(rows_per_shard=3, size=2, stride=1)
    shard_rows(index_build.append_chunks(docs(spark, 4), path, embed4, "m", 4, **args))
    with pytest.raises(Exception, match="no encoder"):
        index_build.append_chunks(
            docs(spark, 40, 4), path, lambda c: c.withColumn("embedding", F.raise_error(F.lit("no encoder")).cast("array<float>")), "m", 4, **args
        )
    shards = shard_rows(index_build.append_chunks(docs(spark, 6, 4), path, embed4, "m", 4, **args))
    got = index_build.read_index(spark, path)
    assert sorted(r["faiss_id"] for r in got.collect()) == list(range(1, shards[-1][4]))
    assert {r["doc_id"] for r in got.collect()} <= {f"d{i:04d}" for i in range(10)}
    assert sum(r[5] for r in shards) == got.count() == index_build.read_index_vectors(spark, path).count()


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_a_further_run_moves_each_text_once(spark, monkeypatch, limit):
    rows = [(f"d{i % 40:03d}", None, " ".join(["w"] * (i % 9)), "") for i in range(60)] + [(None, "t", "null id", "")] * 2
    pages = spark.createDataFrame(rows, "id string, title string, text string, url string")
    path, args = scratch_path(spark, "test-index"), dict(rows_per_shard=10, size=2, stride=1, max_broadcast_keys=limit)
    index_build.append_chunks(pages.where("id < 'd030'"), path, embed4, "m", 4, **args)
    plans, store = [], index_build._replace_shards

    def watched(df, to):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        store(df, to)

    monkeypatch.setattr(index_build, "_replace_shards", watched)
    monkeypatch.setattr(ids, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or materialize(df, name))
    index_build.append_chunks(pages, path, embed4, "m", 4, **args)
    assert plans and not any("hashpartitioning(id#" in p for p in plans)
    got = index_build.read_index(spark, path).collect()
    assert sorted(r["faiss_id"] for r in got) == list(range(1, len(got) + 1))
    want = plain_chunks([(r[0], r[2]) for r in rows], 2, 1)
    assert Counter((r["doc_id"], r["chunk_no"], r["text"]) for r in got) == Counter(want)


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_pages_that_are_asked_for_are_found_by_ids(spark, limit):
    rows = [(f"d{i % 40:03d}", None, " ".join(["w"] * (i % 9)), "") for i in range(60)] + [(None, "t", "null id", "")] * 2
    pages = spark.createDataFrame(rows, "id string, title string, text string, url string")
    asked = [f"d{i:03d}" for i in range(0, 40, 3)]
    only = spark.createDataFrame([(x,) for x in [*asked, *asked, "absent", None]], "id string")
    path, args = scratch_path(spark, "test-index"), dict(rows_per_shard=10, size=2, stride=1, max_broadcast_keys=limit)
    index_build.append_chunks(pages, path, embed4, "m", 4, only=only, **args)
    got = index_build.read_index(spark, path).collect()
    assert sorted(r["faiss_id"] for r in got) == list(range(1, len(got) + 1))
    want = plain_chunks([(r[0], r[2]) for r in rows if r[0] in asked], 2, 1)
    assert Counter((r["doc_id"], r["chunk_no"], r["text"]) for r in got) == Counter(want)
    index_build.append_chunks(pages, path, embed4, "m", 4, only=only, **args)
    assert index_build.read_index(spark, path).count() == len(got)
    index_build.append_chunks(pages, path, embed4, "m", 4, only=only.limit(0), **args)
    assert index_build.read_index(spark, path).count() == len(got)


def test_index_search_shuffles_no_documents_for_the_labelled_ones(spark, monkeypatch, tmp_path):
    docs = [(i, f"title {i}\n" + " ".join(f"w{(i * j) % 11}" for j in range(i % 7))) for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i,) for i in range(0, 30, 4)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    asked = [(f"q{i}", f"w{i} w{i + 1} w{i + 2}") for i in range(3)]
    spark.createDataFrame(asked, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plans = []

    def watched(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, *args, **kwargs)

    store = index_build._replace_shards
    monkeypatch.setattr(ids, "materialize", watched)
    monkeypatch.setattr(index_build, "_replace_shards", lambda df, to: plans.append(df._jdf.queryExecution().executedPlan().toString()) or store(df, to))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if there were many labels
    try:
        got = QUERIES["index_search"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans and not any("hashpartitioning(id#" in p for p in plans)
    assert sorted(r["query_id"] for r in got) == [f"bq{i}" for i in range(3)] and all('"doc_id"' in r["user"] for r in got)


def plain_chunks(rows, size, stride):
    out = []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "")):
        words = (text or "").split()
        at = 0
        while at < len(words):
            out.append((doc, at // stride, " ".join(words[at : at + size])))
            if at + size >= len(words):
                break
            at += stride
    return out


def id_rows():
    rng = random.Random(4)
    rows = [(f"d{rng.randrange(60):03d}", "t", " ".join(["w"] * rng.randrange(12)), "u") for _ in range(80)]
    rows += [("d001", "t", "the same row again and again", "u")] * 2500 + [(None, None, "null id", None)] * 3
    return rows + [(None, "t", None, "u"), ("d002", None, "t", None), ("d002", "t", None, None), ("zz", "", "  ", "")]


@pytest.mark.parametrize("limit", [1_000_000, 0])
@pytest.mark.parametrize("repeated", [100_000, 3, 1])
def test_chunks_are_numbered_where_they_lie(spark, monkeypatch, limit, repeated):
    plans = []

    def watched(df, name):
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return materialize(df, name)

    monkeypatch.setattr(ids, "materialize", watched)
    monkeypatch.setattr(ids, "MAX_REPEATED", repeated)
    df = spark.createDataFrame(id_rows(), "doc_id string, title string, text string, url string").repartition(6)
    got = ids.attach_ids(
        df, ["doc_id"], 7, count=chunk_count(F.col("text"), 4, 3), expand=lambda d: chunk_documents(d, "text", 4, 3),
        place="chunk_no", max_broadcast_keys=limit,
    )
    assert all("text" not in columns for columns, _ in plans)
    assert "rangepartitioning" in plans[0][1] and "rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    rows = sorted(got.collect(), key=lambda r: r["faiss_id"])
    want = plain_chunks([(r[0], r[2]) for r in id_rows()], 4, 3)
    assert [r["faiss_id"] for r in rows] == list(range(7, 7 + len(want)))
    assert [r["doc_id"] for r in rows] == [w[0] for w in want]
    assert Counter((r["doc_id"], r["chunk_no"], r["text"]) for r in rows) == Counter(want)
    for before, row in zip(rows, rows[1:]):  # the chunks of a document have ids in order
        assert row["chunk_no"] == 0 or (row["doc_id"], row["chunk_no"]) == (before["doc_id"], before["chunk_no"] + 1)


def test_broadcast_ids_move_no_text(spark):
    df = spark.createDataFrame([(i, "a b c") for i in range(50)], "doc_id long, text string")
    plan = ids.attach_ids(df, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_x" not in plan and "rangepartitioning" not in plan and "BroadcastHashJoin" in plan
    assert ids.attach_ids(df.where("false"), ["doc_id"]).count() == 0


def test_manifest_plan_does_not_grow(spark):
    sizes = set()
    for n in (10, 10_000):
        path = scratch_path(spark, "test-manifest")
        rows = spark.range(1, n + 1).selectExpr("id AS faiss_id", "format_string('shard_%05d', id) AS shard")
        stores.write_manifest(ids.manifest(rows, "m", 4), path)
        shards = stores.read_manifest(spark, path)
        assert ids.index_state(shards).first()["next_global_id"] == n + 1
        more = rows.selectExpr("faiss_id + 20000 AS faiss_id", "concat(shard, 'x') AS shard")
        sizes.add(len(ids.manifest(more, "m", 4)._jdf.queryExecution().optimizedPlan().toString()) // 100)
    assert len(sizes) == 1


# --- sources --------------------------------------------------------------------


def test_normalize_pages(spark):
    rows = [("1", "9", "a", "x", "u"), ("", "9", "a", "x", None), (None, "", "a", None, "")]
    raw = spark.createDataFrame(rows, "id string, pageid string, title string, text string, url string")
    got = [tuple(r) for r in pages.normalize_pages(raw).collect()]
    assert got == [("1", "a", "x", "u"), ("9", "a", "x", ""), ("a", "a", None, "")]


def test_upsert(spark):
    schema = "doc_id string, title string, seq int"
    base = tables.clean_docs(spark.createDataFrame([("a", "old", 0), ("b", "old", 0)], schema))
    load = spark.createDataFrame([("a", "one", 1), ("a", None, 2), ("c", "new", 3)], schema)
    got = {r["doc_id"]: r for r in tables.upsert_docs(base, load).collect()}
    assert {k: r["title"] for k, r in got.items()} == {"a": "", "b": "old", "c": "new"}
    assert got["c"]["year"] == 0 and got["c"]["authors"] == []


def test_failed_load_is_not_seen(spark):
    root = scratch_path(spark, "test-versions")
    assert versions.current_version(spark, root) == (0, None)
    versions.load_version(spark, root, {"t": spark.range(3)})
    bad = spark.range(3).select(F.raise_error(F.lit("broken")).alias("x"))
    with pytest.raises(Exception):
        versions.load_version(spark, root, {"t": spark.range(5), "u": bad})
    assert versions.read_version(spark, root, "t").count() == 3


def test_results_table(spark):
    path = scratch_path(spark, "test-results")
    row = spark.createDataFrame([("q1", "r1", 3)], "query_id string, run_id string, selected_index int")
    stores.append_results(row, path)
    stores.append_results(row.withColumn("run_id", F.lit("r2")), path)
    got = stores.read_results(spark, path)
    assert got.count() == 2 and got.columns[0] == "run_id" and len(got.columns) == 19


# --- metrics -----------------------------------------------------------------------


def numpy_ndcg(rels):
    gain = lambda r: sum((2.0**x - 1) / math.log2(i + 2) for i, x in enumerate(r))
    best = gain(sorted(rels, reverse=True))
    return gain(rels) / best if best > 0 else 0.0


def test_metrics(spark):
    relevances = {"a": [2, 0, 1], "b": [0, 0], "c": [], "d": [0, 3, 3, 1]}
    hits = [(q, f"{q}{i}", i + 1) for q, r in relevances.items() for i in range(len(r))]
    judged = [(q, f"{q}{i}", x) for q, r in relevances.items() for i, x in enumerate(r) if x]
    judged += judged + [("a", "never found", 1), ("c", "never found", 2)]
    h = spark.createDataFrame(hits, "query_id string, doc_id string, rank int")
    j = spark.createDataFrame(judged, "query_id string, doc_id string, relevance int")
    q = spark.createDataFrame([(x,) for x in relevances], "query_id string")
    rows = {r["query_id"]: r for r in metrics.retrieval_metrics(h, j, q, 4, None).collect()}
    totals = {"a": 3, "b": 0, "c": 1, "d": 3}
    for name, rels in relevances.items():
        found = sum(x > 0 for x in rels)
        assert rows[name]["relevant"] == found and rows[name]["total_relevant"] == totals[name]
        assert math.isclose(rows[name]["precision"], found / 4)
        assert math.isclose(rows[name]["recall"], found / max(1, totals[name]))
        assert math.isclose(rows[name]["ndcg"], numpy_ndcg(rels), abs_tol=1e-12)


def test_hit_stats(spark):
    scores = {"a": [0.5, 1.5, 1.0], "b": [0.7], "c": []}
    hits = [(q, i + 1, s, None if i else "t") for q, v in scores.items() for i, s in enumerate(v)]
    h = spark.createDataFrame(hits, "query_id string, rank int, score double, title string")
    q = spark.createDataFrame([(x,) for x in scores], "query_id string")
    for r in metrics.hit_stats(h, q).collect():
        v = np.array(scores[r["query_id"]] or [0.0])
        p = v / (v.sum() + 1e-9)
        assert np.allclose(
            [r["score_mean"], r["score_std"], r["score_entropy"]],
            [v.mean(), v.std(), -(p * np.log(p + 1e-12)).sum()],
        )
        assert math.copysign(1, r["score_entropy"]) == 1 or r["score_entropy"] != 0
    assert {r["query_id"]: r["unique_titles"] for r in metrics.hit_stats(h, q).collect()} == {"a": 2, "b": 1, "c": 0}


def test_sq8_ends_and_constant(spark):
    df = spark.createDataFrame([([0.0, 5.0, 1.0],), ([1.0, 5.0, 0.5],)], "v array<double>")
    low, high = F.array(*map(F.lit, [0.0, 5.0, 0.0])), F.array(*map(F.lit, [1.0, 5.0, 1.0]))
    codes = encode(F.col("v"), low, high)
    got = df.select(codes.alias("c"), decode(codes, low, high).alias("d")).collect()
    assert [r["c"] for r in got] == [[0, 0, 255], [255, 0, 127]]
    assert got[0]["d"][1] == 5.0


# --- selection ------------------------------------------------------------------------


@pytest.mark.parametrize(
    "content,index,error",
    [
        ('{"index": 0}', 0, None),
        ('{"index": null}', None, None),
        ("{}", None, None),
        ("[1]", None, None),
        ('{"index": true}', 1, None),
        ('{"index": "2"}', 2, None),
        ('{"index": 2.7}', 2, None),
        ('{"index": 99}', None, " invalid_index:99"),
        ('{"index": -1}', None, " invalid_index:-1"),
        ('{"index": "2.7"}', None, " cast_index_error:invalid literal for int() with base 10: '2.7'"),
        ('{"index": 3} x', None, "json_parse_error: Extra data: line 1 column 14 (char 13)"),
        ("", None, "json_parse_error: Expecting value: line 1 column 1 (char 0)"),
        (None, None, "json_parse_error: Expecting value: line 1 column 1 (char 0)"),
    ],
)
def test_lenient(content, index, error):
    assert lenient(content, 10)[1:] == (index, error)


def test_strict():
    assert [strict(c, 10)[1] for c in ('{"index": 3}', '{"index": true}', '{"index": "2"}', '{"index": 2.7}', '{"index": 10}', "x")] == [3, 1, None, None, None, None]


def test_prompt_leaves_placeholders_of_the_query_alone(spark):
    row = spark.createDataFrame([("{{ documents_json }}", "[]")], "q string, d string")
    got = row.select(selection.fill_prompt(F.col("q"), F.col("d"))).first()[0]
    assert "Query:\n{{ documents_json }}\n\nDocuments (JSON array):\n[]" in got


def test_reasoning(spark):
    one = spark.range(1)
    get = lambda **kw: one.select(selection.reasoning_json(**kw)).first()[0]
    assert get() is None
    assert json.loads(get(effort="low", max_tokens=0, exclude=True, enabled=True)) == {
        "effort": "low", "max_tokens": 0, "exclude": True, "enabled": True
    }


def test_scoring_keeps_every_query(spark):
    q = spark.createDataFrame([(x, "text") for x in "abcde"], "query_id string, text string")
    hits = spark.createDataFrame(
        [(x, i + 1, f"{x}{i}", "t", 0.5) for x in "abcd" for i in range(3)],
        "query_id string, rank int, doc_id string, title string, score double",
    )
    judged = spark.createDataFrame([("a", "a1", 1), ("c", "c2", 1)], "query_id string, doc_id string, relevance int")
    answers = [("a", '{"index": 1}', None), ("b", "{}", None), ("c", "{}", None), ("d", None, "timed out")]
    responses = spark.createDataFrame(
        [("r", "m", x, t, 1, 2, 3, 4.0, e) for x, t, e in answers],
        "run_id string, model string, query_id string, response_text string, prompt_tokens int, reasoning_tokens int, completion_tokens int, latency_ms double, request_error string",
    )
    asked = q.selectExpr("'r' AS run_id", "'m' AS model", "query_id")
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = {r["query_id"]: r for r in selection.score_selections(asked, q, hits, judged, responses, 3, now=now).collect()}
    assert {x: r["correct"] for x, r in rows.items()} == {"a": True, "b": False, "c": None, "d": None, "e": None}
    assert rows["a"]["selected_doc_id"] == "a1" and json.loads(rows["a"]["retrieved"])[0]["doc_id"] == "a0"
    assert rows["d"]["parse_error"] == "request_error: timed out" and rows["d"]["retrieved"] == "[]"
    assert rows["e"]["parse_error"] == "request_error: no response recorded"


def test_every_run_keeps_the_queries_it_did_not_answer(spark):
    q = spark.createDataFrame([("a", "t"), ("b", "t")], "query_id string, text string")
    asked = spark.createDataFrame([(r, "m", x) for r in ("r1", "r2", None) for x in "ab"], "run_id string, model string, query_id string")
    hits = spark.createDataFrame([], "query_id string, rank int, doc_id string, title string, score double")
    judged = spark.createDataFrame([], "query_id string, doc_id string, relevance int")
    answers = [("r1", "a"), ("r1", "b"), ("r2", "a")]
    responses = spark.createDataFrame(
        [(r, "m", x, "{}", 1, 2, 3, 4.0, None) for r, x in answers],
        "run_id string, model string, query_id string, response_text string, prompt_tokens int, reasoning_tokens int, completion_tokens int, latency_ms double, request_error string",
    )
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = selection.score_selections(asked, q, hits, judged, responses, 3, now=now).collect()
    named = "m" + selection.run_suffix(now)
    assert sorted((r["run_id"], r["query_id"]) for r in rows) == [(r, x) for r in sorted([named, "r1", "r2"]) for x in "ab"]
    missing = [(r["run_id"], r["query_id"]) for r in rows if r["parse_error"]]
    assert sorted(missing) == sorted([(named, "a"), (named, "b"), ("r2", "b")])


def test_free_text_keeps_its_documents_in_single_mode(spark):
    q = hits_of.query_of_text(spark, "what")
    hits = spark.createDataFrame([("free text", 1, "d", "t", "s" * 900)], "query_id string, rank int, doc_id string, title string, snippet string")
    row = selection.selection_requests(q, hits, "m", mode="single", run_id="r").first()
    assert row["run_id"] == "r" and row["response_format"] is None and row["system"] == selection.SYSTEM_SINGLE
    assert "s" * 800 in row["user"] and "s" * 801 not in row["user"]


def test_quantiles_are_exact(spark):
    values = [float(x * x % 97) for x in range(200)]
    rows = spark.createDataFrame([("r", "m", v) for v in values] + [("r", "m", None)], "run_id string, model string, latency_ms double")
    got = metrics.latency_quantiles(rows, {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0}).first()
    assert np.allclose([got[x] for x in "abcd"], np.quantile(values, [0.5, 0.95, 0, 1]))


def latencies(spark, rows):
    return spark.createDataFrame(rows, "run_id string, model string, latency_ms double")


def test_quantiles_of_a_million_latencies(spark, monkeypatch):
    n = 1_000_000
    rows = spark.range(n, numPartitions=16).selectExpr("'r' AS run_id", "'m' AS model", "pow(id, 1.5) AS latency_ms")
    rows = rows.unionByName(latencies(spark, [("s", None, 5.0), ("s", None, 7.0), (None, "m", 1.0)]))
    sizes = []
    real = metrics._same_run

    def watched(counts, places):
        sizes.append(places.agg(F.max("values")).first()[0])
        return real(counts, places)

    monkeypatch.setattr(metrics, "_same_run", watched)
    got = {r["run_id"]: r for r in metrics.latency_quantiles(rows, {"a": 0.5, "b": 0.95, "c": 1.0}).collect()}
    want = np.quantile(np.arange(n) ** 1.5, [0.5, 0.95, 1])
    assert np.allclose([got["r"][x] for x in "abc"], want, rtol=1e-12)
    assert (got["s"]["a"], got[None]["b"]) == (6.0, 1.0)
    assert sizes[0] == n and sizes[-1] <= metrics.FEW_VALUES  # the last one is what is put in order


@pytest.mark.parametrize("few,bins", [(1, 2), (3, 7), (10_000, 1024)])
def test_quantiles_equal_numpy(spark, few, bins):
    rng = random.Random(few)
    made = {
        "a": [rng.choice([0.0, -1.5, 3.25, 1e300, -1e300]) for _ in range(40)], "b": [rng.random() for _ in range(57)],
        "c": [2.0] * 9, "d": [1.0], "e": [float("inf"), 1.0, 2.0, 3.0, float("-inf")], "f": [5e-324 * i for i in range(30)],
    }
    rows = [(run, "m", x) for run, values in made.items() for x in values] + [("a", "m", None), ("b", "m", float("nan")), ("z", "m", None)]
    q = {"low": 0.0, "mid": 0.5, "high": 0.75, "top": 1.0}
    got = {r["run_id"]: r for r in metrics.latency_quantiles(latencies(spark, rows).repartition(3), q, few, bins).collect()}
    assert set(got) == set(made)
    for run, values in made.items():
        ordered = sorted(values)
        for name, share in q.items():
            at = share * (len(ordered) - 1)
            low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
            want = low if low == high else low + (high - low) * (at - math.floor(at))
            assert got[run][name] == pytest.approx(want, rel=1e-12, abs=0), (run, name)
    assert metrics.latency_quantiles(latencies(spark, rows).where("false"), q).count() == 0


def test_queries_are_picked_beyond_one_partition(spark):
    q = spark.range(4000, numPartitions=8).selectExpr("format_string('q%05d', (id * 7) % 4000) AS query_id", "concat('t', id) AS text")
    for offset in (0, 9, 10, 2741, 3999):
        assert hits_of.query_by_offset(q, offset, few=10).first()["query_id"] == f"q{offset:05d}"
    with pytest.raises(Exception, match="beyond the end"):
        hits_of.query_by_offset(q, 4000, few=10).collect()
    for n in (5, 10, 11, 3333, 4000, 9000):
        got = sorted(r["query_id"] for r in hits_of.sample_queries(q, n, few=10).collect())
        assert got == [f"q{i:05d}" for i in range(min(n, 4000))]
    twice = q.where("query_id < 'q00010'").unionByName(q.where("query_id < 'q00010'"))
    assert [r["query_id"] for r in hits_of.sample_queries(twice, 15, few=1).orderBy("query_id").collect()] == [f"q{i // 2:05d}" for i in range(15)]
    plan = hits_of.sample_queries(q, 3333, few=10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan and "rangepartitioning" not in plan


def test_a_document_that_every_query_finds(spark):
    queries = spark.createDataFrame([(f"q{i}", f"w{i % 5} hub x") for i in range(300)], "query_id string, text string")
    texts = [("hub", None, "hub w0 w1"), ("d1", "x", "w3"), ("d2", None, None)]
    docs = spark.createDataFrame(texts, "doc_id string, title string, text string")
    near = [(f"q{i}", j, d, j + 1, 0.5) for i in range(300) for j, d in enumerate(("hub", "d1", "gone") if i % 2 else ("hub", "d2"))]
    hits = spark.createDataFrame(near, "query_id string, faiss_id long, doc_id string, rank int, score double")
    plain = sorted(map(tuple, rerank.rerank_lexical(hits, queries, docs, 2).collect()))
    for limit in (100, 7, 1):
        found = rerank.rerank_lexical(hits, queries, docs, 2, pairs_per_part=limit)
        assert "_part" in found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, found.collect())) == plain
    assert len(plain) == 600


def test_a_load_of_judgements_tried_again_adds_nothing(spark):
    path = scratch_path(spark, "test-qrels")
    load = spark.createDataFrame([("q", "d", 1, None), ("q", "d", 1, None)], "query_id string, doc_id string, relevance int, iteration string")
    for batch, rows in (("a", 2), ("a", 2), ("b", 4), ("a", 4)):
        tables.append_qrels(load, path, batch)
        assert tables.read_qrels(spark, path).count() == rows
    assert tables.read_qrels(spark, path).first() == ("q", "d", 1, "")
    with pytest.raises(ValueError):
        tables.append_qrels(load, path, "")


@pytest.mark.parametrize("pick,filter_", [("query_by_id", "EqualTo(vec_id,7)"), ("qrels_of_query", "EqualTo(l_suppkey,7)")])
def test_lookups_reach_the_scan(spark, capsys, pick, filter_):
    QUERIES[pick](spark, "/root/testdata/sf0.001").explain("formatted")
    assert filter_ in capsys.readouterr().out


@pytest.mark.parametrize("candidates", [None, 3, 60])
def test_rerank_never_cuts_below_k(candidates):
    if candidates == 3:
        with pytest.raises(ValueError):
            hits_of.rerank_depth(100, candidates)
    else:
        assert hits_of.rerank_depth(60, candidates) == 60


def test_payload_cuts(spark):
    hits = spark.createDataFrame([("q", 1, "d", "t" * 300, "s" * 2000), ("q", 2, None, None, None)],
                                 "query_id string, rank int, doc_id string, title string, snippet string")
    got = json.loads(selection.payload(hits, 800).first()["documents_json"])
    assert [len(got[0]["title"]), len(got[0]["snippet"])] == [200, 800]
    assert got[1] == {"index": 1, "title": "", "doc_id": None, "snippet": ""}


def test_missing_query(spark):
    q = spark.createDataFrame([("a", "t")], "query_id string, text string")
    with pytest.raises(Exception, match="not found"):
        hits_of.query_by_id(q, "b").collect()
    with pytest.raises(Exception, match="beyond the end"):
        hits_of.query_by_offset(q, 1).collect()
    assert hits_of.query_by_offset(q, 0).collect() == [("a", "t")]


def test_judged_pairs_without_vectors_are_not_grouped(spark):
    plan = QUERIES["l2_distance"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2 and plan.index("Aggregate") < plan.index("LeftSemi")


def test_texts_stay_behind_the_scorer(spark):
    rows = [("q", i, i + 1, "a b", "w " * i) for i in range(5)]
    pairs = spark.createDataFrame(rows, "query_id string, faiss_id long, rank int, query_text string, full_text string")
    load = lambda: lambda both: [len(text) for _, text in both]
    found = rerank.rerank_with(pairs, load, 2, keep=["query_id", "faiss_id", "rank"])
    assert found.collect() == [("q", 4, 1, 8.0), ("q", 3, 2, 6.0)]
    assert "full_text" not in found._jdf.queryExecution().optimizedPlan().toString().split("MapInPandas")[0]
    assert rerank.rerank_with(pairs, load, 2).columns == [*pairs.columns, "rerank_score"]


def _odd_candidates(spark):
    """Hits, queries and documents with ids that repeat, are null, or are missing on the other side."""
    texts = [(f"q{i}", f"w{i % 5} w{i % 3} x é") for i in range(40)] + [("q3", "w0 again"), ("q4", None), (None, "w1")]
    queries = spark.createDataFrame(texts, "query_id string, text string")
    rows = [(f"d{i}", None if i % 4 else "w2", f"w{i % 5} x w{i % 2}") for i in range(9)] + [("d1", "w9", "w0 again"), (None, "x", "x"), ("d8", None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, title string, text string")
    near = [(f"q{i}", j, None if (i + j) % 7 == 0 else f"d{(i * j) % 11}", j + 1, i / (j + 2)) for i in range(44) for j in range(6)]
    hits = spark.createDataFrame([*near, *near[30:40], (None, 1, "d1", 1, 0.5)], "query_id string, faiss_id long, doc_id string, rank int, score double")
    expected = []
    for query_id, faiss_id, doc_id, rank, score in map(tuple, hits.collect()):
        held = [f"{title or ''}\n\n{text or ''}".strip() for d, title, text in rows if d == doc_id and d is not None] or [""]
        expected += [(query_id, doc_id, faiss_id, rank, score, asked or "", full) for q, asked in texts if q == query_id and q is not None for full in held]
    return hits, queries, docs, expected


@pytest.mark.parametrize("round_bytes,pairs_per_part", [(32 << 20, 10_000), (400, 10_000), (400, 5), (32 << 20, 1)])
def test_pairs_in_rounds_are_all_pairs(spark, round_bytes, pairs_per_part):
    hits, queries, docs, expected = _odd_candidates(spark)
    asked = queries.select("query_id", F.col("text").alias("query_text"))
    attach = lambda listed: hits_of.hits_text(listed, docs).drop("snippet")
    rounds = rerank.pair_rounds(hits, asked, attach, pairs_per_part, round_bytes)
    assert (len(rounds) > 3) == (round_bytes == 400)
    columns = ["query_id", "doc_id", "faiss_id", "rank", "score", F.coalesce("query_text", F.lit("")), "full_text"]
    found = [tuple(r) for some in rounds for r in some.select(*columns).collect()]
    assert sorted(map(str, found)) == sorted(map(str, expected))

    load = lambda: lambda both: [len(text) - len(asked) for asked, text in both]
    keep = ["query_id", "faiss_id", "rank"]
    plain = spark.createDataFrame(expected, "query_id string, doc_id string, faiss_id long, rank int, score double, query_text string, full_text string")
    best = lambda pairs: sorted(map(tuple, rerank.rerank_with(pairs, load, 3, keep=keep).collect()))
    assert best(rounds) == best(plain)

    share = lambda asked, text: len(set(asked.split()) & set(text.split())) / max(1, len(set(asked.split())))
    every = spark.createDataFrame([(*row[:5], share(*row[5:])) for row in expected], "query_id string, doc_id string, faiss_id long, rank int, score double, share double")
    kept = ["query_id", "faiss_id", "rank", "rerank_score"]
    lexical = rerank.rerank_lexical(hits, queries, docs, 3, None, pairs_per_part, round_bytes)
    assert lexical.columns == ["query_id", "doc_id", "faiss_id", "rank", "score", "rerank_score"]
    shown = lambda df: sorted(map(tuple, df.select(*kept).collect()))
    assert shown(lexical) == shown(rerank.rerank(every, F.col("share"), 3))


@pytest.mark.parametrize("name", ["rerank_lexical", "rerank_with"])
def test_no_text_is_shuffled_with_a_pair(spark, monkeypatch, name):
    plans = []
    score = rerank.rerank
    monkeypatch.setattr(rerank, "rerank", lambda pairs, *args: plans.append(pairs) or score(pairs, *args))
    monkeypatch.setattr(rerank, "in_turn", lambda rounds: rounds[0], raising=False)  # as planned, not as stored
    QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"(\w+Join) \[query_id#\d+\], \[query_id#\d+\]", plan)
    assert joins and set(joins) == {"BroadcastHashJoin"}


def test_documents_are_chosen_where_they_lie(spark):
    hits, queries, docs, _ = _odd_candidates(spark)
    for limit, join in ((100, "BroadcastHashJoin"), (3, "SortMergeJoin")):
        found = hits_of.fetch_doc_texts(docs, hits_of.listed_ids(hits, limit))
        assert re.search(rf"{join}.*LeftSemi", found._jdf.queryExecution().executedPlan().toString()) or limit == 3
        assert sorted(r["doc_id"] for r in found.collect()) == sorted(["d1", "d8", *(f"d{i}" for i in range(9))])
    plan = views.queries(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin.*LeftSemi", plan)
