"""Registered queries: selection requests, responses, scoring, results."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovescan.operators import hits as hits_of
from trovescan.operators import selection
from trovescan.operators.metrics import run_summary as summarize
from trovescan.plans import views
from trovescan.plans.registry import query
from trovescan.session import scratch_path
from trovescan.sources import stores

_NOW = datetime(2024, 1, 1, tzinfo=timezone.utc)


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every query that have metadata."""
    near = views.hits(spark, sf_dir).drop("doc_id")
    return hits_of.hits_meta(near, views.meta(spark, sf_dir))


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits_of.hits_text(_found(spark, sf_dir), views.docs(spark, sf_dir), full=False)


def _scored(spark: SparkSession, sf_dir: str, mode: str = "lenient") -> DataFrame:
    return selection.score_selections(
        views.requests(spark, sf_dir),
        views.queries(spark, sf_dir),
        _found(spark, sf_dir),
        views.qrels(spark, sf_dir),
        views.responses(spark, sf_dir),
        k=10,
        reasoning=selection.reasoning_json(effort="medium"),
        now=_NOW,
        mode=mode,
    )


# The documents as shown: hits with metadata, numbered in rank order.
_FOUND = """
    , found AS (
      SELECT h.query_id, h.rank, h.score, m.doc_id, m.title, t.full_text
      FROM hits h JOIN meta m USING (faiss_id) LEFT JOIN doc_texts t ON m.doc_id = t.doc_id)"""
_VIEWS = "docs queries qrels qrels_unique meta requests responses pairs ranked hits doc_texts"
_PAYLOAD = """
    , payloads AS (
      SELECT query_id, count(*) AS shown, CAST(to_json(list(
               {'index': rank - 1, 'title': left(title, 200), 'doc_id': doc_id,
                'snippet': CASE WHEN length(full_text) > 220 THEN concat(left(full_text, 220), '…')
                                ELSE coalesce(full_text, '') END} ORDER BY rank)) AS STRING) AS documents_json
      FROM found GROUP BY query_id)"""
# What each form of response means to the lenient and the strict reader.
_READ = """
    , counts AS (SELECT query_id, count(*) AS n FROM found GROUP BY query_id),
    read AS (
      SELECT a.run_id, a.model, a.query_id, r.* EXCLUDE (run_id, model, query_id), q.text AS query_text,
        coalesce(n, 0) AS n, r.query_id IS NOT NULL AS recorded,
        CASE WHEN r.query_id IS NULL THEN 'no response recorded' ELSE request_error END AS why, why IS NOT NULL AS failed,
        CASE WHEN response_text IN ('not json', '') THEN
               'json_parse_error: Expecting value: line 1 column 1 (char 0)'
             WHEN response_text LIKE '% x' THEN 'json_parse_error: Extra data: line 1 column 14 (char 13)'
        END AS bad,
        CASE response_text WHEN '{"index": 0}' THEN 0 WHEN '{"index": 3}' THEN 3 WHEN '{"index": 99}' THEN 99
          WHEN '{"index": "2"}' THEN 2 WHEN '{"index": 2.7}' THEN 2 WHEN '{"index": true}' THEN 1
          WHEN '{"index": -1}' THEN -1 END AS wish
      FROM requests a JOIN queries q ON a.query_id = q.query_id
      LEFT JOIN responses r ON a.query_id = r.query_id AND a.run_id = r.run_id
      LEFT JOIN counts c ON q.query_id = c.query_id),
    chosen AS (
      SELECT *, CASE WHEN wish BETWEEN 0 AND n - 1 THEN wish END AS sel,
        CASE WHEN wish NOT BETWEEN 0 AND n - 1 THEN concat(' invalid_index:',
               CASE response_text WHEN '{"index": 2.7}' THEN '2.7' WHEN '{"index": true}' THEN 'True'
                                  ELSE CAST(wish AS STRING) END)
        ELSE bad END AS error
      FROM read)"""
_SCORED = """
    , rel AS (
      SELECT f.query_id, f.rank, f.doc_id, coalesce(u.relevance, 0) AS relevance
      FROM found f LEFT JOIN qrels_unique u ON f.query_id = u.query_id AND f.doc_id = u.doc_id),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS place FROM rel),
    anyrel AS (SELECT query_id, bool_or(relevance > 0) AS has FROM rel GROUP BY query_id),
    scored AS (
      SELECT c.*, p.doc_id AS picked, coalesce(a.has, false) AS has,
        CASE WHEN p.doc_id IS NOT NULL THEN p.relevance > 0
             WHEN NOT coalesce(a.has, false) THEN false END AS ok
      FROM chosen c LEFT JOIN placed p ON c.query_id = p.query_id AND c.sel = p.place
      LEFT JOIN anyrel a ON c.query_id = a.query_id)"""


@query(
    _VIEWS,
    _FOUND + _PAYLOAD + "SELECT query_id, CAST(shown AS INT) AS shown, documents_json FROM payloads",
)
def payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.payload(_shown(spark, sf_dir))


_PROMPT = selection.PROMPT.replace("'", "''").split("{{ query }}")


@query(
    _VIEWS,
    _FOUND
    + _PAYLOAD
    + f"""
    SELECT 'run-1' AS run_id, query_id, 'model-a' AS model, '{selection.SYSTEM_BATCH}' AS system,
      concat('{_PROMPT[0]}', coalesce(text, 'None'), '{_PROMPT[1].replace("{{ documents_json }}", "")}',
             coalesce(documents_json, '[]')) AS "user",
      CAST(0 AS DOUBLE) AS temperature, '{{"type":"json_object"}}' AS response_format,
      '{{"effort":"low","exclude":true}}' AS reasoning
    FROM queries LEFT JOIN payloads USING (query_id)""",
)
def selection_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request for every query."""
    return selection.selection_requests(
        views.queries(spark, sf_dir),
        _shown(spark, sf_dir),
        model="model-a",
        run_id="run-1",
        reasoning=selection.reasoning_json(effort="low", exclude=True),
    )


@query(
    _VIEWS,
    _FOUND
    + """SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS INT) AS place,
           doc_id, title, round(score, 6) AS score
         FROM found""",
)
def retrieved_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of every query as JSON, read back into rows."""
    written = selection.retrieved(_found(spark, sf_dir))
    listed = F.from_json("retrieved", "array<struct<doc_id:string,title:string,score:double>>")
    return (
        written.select("query_id", F.posexplode(listed).alias("place", "hit"))
        .select("query_id", "place", "hit.doc_id", "hit.title", F.round("hit.score", 6).alias("score"))
    )


def _read(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    shown = _found(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("shown"))
    asked = views.queries(spark, sf_dir).select("query_id").join(shown, "query_id", "left")
    return selection.parse_responses(
        views.responses(spark, sf_dir), asked.fillna(0, ["shown"]), mode
    )


@query(
    _VIEWS,
    _FOUND
    + _READ
    + """SELECT run_id, query_id, n AS shown, bad IS NULL AND NOT failed AS valid, sel AS selected_index,
         CASE WHEN failed THEN 'json_parse_error: Expecting value: line 1 column 1 (char 0)' ELSE error END AS parse_error
         FROM chosen WHERE recorded""",
)
def parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recorded response as the lenient reader takes it."""
    return _read(spark, sf_dir, "lenient").select(
        "run_id", "query_id", "shown", "valid", "selected_index", "parse_error"
    )


@query(
    _VIEWS,
    _FOUND + _READ + "SELECT query_id, sel AS selected_index, failed OR error IS NOT NULL AS bad FROM chosen WHERE recorded",
)
def select_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("parse_error").isNotNull().alias("bad")
    return _read(spark, sf_dir, "lenient").select("query_id", "selected_index", bad)


@query(
    _VIEWS,
    _FOUND
    + _READ
    + """SELECT query_id, failed OR bad IS NOT NULL OR response_text = '[1]' AS bad,
           CASE WHEN response_text NOT IN ('{"index": "2"}', '{"index": 2.7}') THEN sel END AS selected_index
         FROM chosen WHERE recorded""",
)
def select_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("parse_error").isNotNull().alias("bad")
    return _read(spark, sf_dir, "strict").select("query_id", "selected_index", bad)


_RESULT = """
    SELECT run_id, '2024-01-01 00:00:00' AS ts, model, '{"effort":"medium"}' AS reasoning, query_id,
           query_text, 10 AS k, CAST(CASE WHEN failed THEN 0 ELSE n END AS INT) AS retrieved,
           CASE WHEN NOT failed AND bad IS NULL THEN response_text END AS response_json,
           CASE WHEN NOT failed THEN response_text END AS response_text,
           CASE WHEN NOT failed THEN sel END AS selected_index,
           CASE WHEN NOT failed THEN picked END AS selected_doc_id,
           CASE WHEN failed THEN concat('request_error: ', why) ELSE error END AS parse_error,
           CASE WHEN NOT failed THEN has END AS any_relevant_in_topk,
           CASE WHEN NOT failed THEN ok END AS correct,
           CASE WHEN NOT failed THEN prompt_tokens END AS usage_prompt_tokens,
           CASE WHEN NOT failed THEN reasoning_tokens END AS usage_reasoning_tokens,
           CASE WHEN NOT failed THEN completion_tokens END AS usage_completion_tokens, latency_ms
    FROM scored"""


def _result_columns(results: DataFrame) -> DataFrame:
    """Results with the time as text and the hit list as its length, for comparing."""
    return results.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).withColumn(
        "retrieved", F.coalesce(F.json_array_length("retrieved"), F.lit(0))
    )


@query(_VIEWS, _FOUND + _READ + _SCORED + _RESULT)
def score_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result row of every query."""
    return _result_columns(_scored(spark, sf_dir))


@query(_VIEWS, _FOUND + _READ + _SCORED + _RESULT)
def append_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of both runs, appended to the result table one after the other, read back."""
    path = scratch_path(spark, "results")
    results = _scored(spark, sf_dir)
    stores.append_results(results.where(F.col("run_id") == "run-1"), path)
    stores.append_results(results.where(F.col("run_id") != "run-1"), path)
    return _result_columns(stores.read_results(spark, path))


@query(
    _VIEWS,
    _FOUND
    + _READ
    + _SCORED
    + f""", results AS ({_RESULT})
    SELECT run_id, model, count(*) AS queries, round(avg(CAST(correct AS INT)), 6) AS correct_rate,
           round(avg(CAST(any_relevant_in_topk AS INT)), 6) AS relevant_rate,
           count(parse_error) AS parse_errors, CAST(sum(usage_prompt_tokens) AS BIGINT) AS prompt_tokens,
           CAST(sum(usage_reasoning_tokens) AS BIGINT) AS reasoning_tokens,
           CAST(sum(usage_completion_tokens) AS BIGINT) AS completion_tokens,
           round(quantile_cont(latency_ms, 0.5), 6) AS latency_p50, round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95,
           CASE WHEN model = 'openai/gpt-5' THEN
             round((sum(usage_prompt_tokens) * 1.25::DOUBLE + sum(usage_completion_tokens) * 10.0::DOUBLE) / 1e6, 6)
           END AS cost
    FROM results GROUP BY run_id, model""",
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = summarize(_scored(spark, sf_dir), stores.prices(spark))
    for name in ("correct_rate", "relevant_rate", "cost", "latency_p50", "latency_p95"):
        done = done.withColumn(name, F.round(name, 6))
    return done
