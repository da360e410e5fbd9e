"""Selection requests to a language model, and the scoring of its answers.

Calling the model is outside: requests leave as a table, responses come back
as one, and the two meet again here.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovescan.functions.choice import choice
from trovescan.functions.text import clip
from trovescan.operators.hits import judge_hits
from trovescan.schemas import RESULTS
from trovescan.sources.tables import conform

# The prompt, the two system messages and the cuts of the payload.
PROMPT = """You are a precise selector. Choose the single document that best answers the query (or null).

Respond ONLY with JSON: {"index": <int or null>}. If there are any other elements of the JSON other than "index" the parsing will fail.

Query:
{{ query }}

Documents (JSON array):
{{ documents_json }}"""
SYSTEM_BATCH = 'Respond ONLY with JSON: {"index": <int or null>}.'
SYSTEM_SINGLE = (
    "You must respond with valid JSON only. Output exactly one key: index (integer or null)."
)
TITLE_CUT = 200
SNIPPET_CUT_BATCH = 1200
SNIPPET_CUT_SINGLE = 800

_KEEP_NULLS = {"ignoreNullFields": "false"}


def payload(
    hits: DataFrame, snippet_cut: int = SNIPPET_CUT_BATCH, title_cut: int = TITLE_CUT
) -> DataFrame:
    """The documents shown for each query, as a JSON array in rank order.

    ``hits`` are the ranked top-k hits with title and snippet, k rows per query.
    """
    shown = F.struct(
        (F.col("rank") - 1).cast("int").alias("index"),
        clip(F.coalesce("title", F.lit("")), title_cut).alias("title"),
        F.col("doc_id"),
        clip(F.coalesce("snippet", F.lit("")), snippet_cut).alias("snippet"),
    )
    documents = F.sort_array(F.collect_list(shown))
    return hits.groupBy("query_id").agg(
        F.to_json(documents, _KEEP_NULLS).alias("documents_json"),
        F.count("*").cast("int").alias("shown"),
    )


def reasoning_json(
    effort: str | None = None,
    max_tokens: int | None = None,
    exclude: bool = False,
    enabled: bool = False,
) -> Column:
    """Reasoning settings as JSON with only the keys that are set; null if none is."""
    set_ = F.struct(
        F.lit(effort or None).cast("string").alias("effort"),
        F.lit(max_tokens).cast("int").alias("max_tokens"),
        F.lit(exclude or None).cast("boolean").alias("exclude"),
        F.lit(enabled or None).cast("boolean").alias("enabled"),
    )
    return F.nullif(F.to_json(set_), F.lit("{}"))  # nulls are left out


def fill_prompt(query: Column, documents: Column, template: str = PROMPT) -> Column:
    """Put both values into the template, each placeholder wherever it stands.

    The template is cut at its placeholders, so a query that contains one of
    them is left alone.
    """
    values = {"{{ query }}": query, "{{ documents_json }}": documents}
    parts, rest = [], template.removesuffix("\n")
    while True:
        found = [(rest.find(mark), mark) for mark in values if mark in rest]
        if not found:
            return F.concat(*parts, F.lit(rest))
        at, mark = min(found)
        parts += [F.lit(rest[:at]), F.coalesce(values[mark], F.lit("None"))]
        rest = rest[at + len(mark) :]


def selection_requests(
    queries: DataFrame,
    hits: DataFrame,
    model: str,
    mode: str = "batch",
    template: str = PROMPT,
    reasoning: Column | None = None,
    run_id: str | None = None,
    title_cut: int = TITLE_CUT,
    snippet_cut: int | None = None,
    now: datetime | None = None,
) -> DataFrame:
    """One request per query: run, system and user message, format and settings.

    A run without an id is named by its model and the time. Titles and snippets are cut to
    ``title_cut`` and ``snippet_cut`` characters (by default what the mode has).
    """
    batch = {"batch": True, "single": False}[mode]
    run_id = run_id or model + run_suffix(now or datetime.now(timezone.utc))
    cut = SNIPPET_CUT_BATCH if batch else SNIPPET_CUT_SINGLE
    documents = payload(hits, cut if snippet_cut is None else snippet_cut, title_cut)
    asked = queries.select("query_id", "text").join(documents, "query_id", "left")
    listed = F.coalesce("documents_json", F.lit("[]"))
    nothing = F.lit(None).cast("string")
    return asked.select(
        F.lit(run_id).alias("run_id"),
        "query_id",
        F.lit(model).alias("model"),
        F.lit(SYSTEM_BATCH if batch else SYSTEM_SINGLE).alias("system"),
        fill_prompt(F.col("text"), listed, template).alias("user"),
        F.lit(0.0).alias("temperature"),
        (F.lit('{"type":"json_object"}') if batch else nothing).alias("response_format"),
        (nothing if reasoning is None else reasoning).alias("reasoning"),
    )


def _listed_hits(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """Per query: its hits in rank order, each with its relevance. At most k to a query."""
    entry = F.struct("rank", "doc_id", "title", "score", "relevance")
    return (
        judge_hits(hits, qrels)
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(entry)).alias("_hits"))
    )


def retrieved_json(hits: Column) -> Column:
    """Hits as JSON: document, title and score, in rank order."""
    shown = F.transform(
        hits,
        lambda h: F.struct(
            h["doc_id"].alias("doc_id"), h["title"].alias("title"), h["score"].alias("score")
        ),
    )
    return F.to_json(shown, _KEEP_NULLS)


def retrieved(hits: DataFrame) -> DataFrame:
    """``retrieved_json`` of each query."""
    entry = F.struct("rank", "doc_id", "title", "score")
    return hits.groupBy("query_id").agg(
        retrieved_json(F.sort_array(F.collect_list(entry))).alias("retrieved")
    )


def parse_responses(responses: DataFrame, shown: DataFrame, mode: str = "lenient") -> DataFrame:
    """Add validity, selected index and error of each response.

    ``shown`` gives (query_id, shown), the number of documents the model saw.
    """
    counted = responses.join(shown.select("query_id", "shown"), "query_id", "left")
    read = choice(F.col("response_text"), F.coalesce("shown", F.lit(0)), mode)
    return counted.withColumn("_read", read).select(*responses.columns, "shown", "_read.*")


def run_suffix(now: datetime) -> str:
    """What a run without an id appends to its model name."""
    return f"-{now.astimezone(timezone.utc):%Y%m%dT%H%M%SZ}"


def score_selections(
    requests: DataFrame,
    queries: DataFrame,
    hits: DataFrame,
    qrels: DataFrame,
    responses: DataFrame,
    k: int,
    reasoning: Column | None = None,
    now: datetime | None = None,
    mode: str = "lenient",
) -> DataFrame:
    """One result row per request (run_id, model, query_id) and recorded response.

    Requests and responses meet on run and query, so a query that one run did not answer keeps its row
    in that run. A request without a run belongs to one named by its model and ``now``.
    ``correct`` has three values: a selected document is right or wrong; no
    selection is wrong where no hit was relevant, and undecided (null) where
    one was. A failed or missing request keeps its row, with an empty hit
    list and the error. ``now`` is fixed once, so that retried tasks agree.
    """
    now = now or datetime.now(timezone.utc)
    wanted = hits.where(F.col("rank") <= k)
    listed = _listed_hits(wanted, qrels)
    named = F.coalesce("run_id", F.concat("model", F.lit(run_suffix(now)))).alias("run_id")
    recorded = responses.select(named, *[c for c in responses.columns if c not in ("run_id", "model")])
    recorded = recorded.withColumn("_recorded", F.lit(True))
    asked = (
        requests.select(named, "model", "query_id")
        .join(queries.select("query_id", F.col("text").alias("query_text")), "query_id", "left")
        .join(recorded, ["run_id", "query_id"], "left")
        .join(listed, "query_id", "left")
        .withColumn("_hits", F.coalesce("_hits", F.array().cast(listed.schema["_hits"].dataType)))
    )
    read = asked.withColumn("_read", choice(F.col("response_text"), F.size("_hits"), mode))
    chosen = F.get("_hits", F.col("_read.selected_index"))
    relevant = F.exists("_hits", lambda h: h["relevance"] > 0)
    # A selected document without an id cannot be judged.
    picked = chosen["doc_id"]
    correct = F.when(picked.isNotNull(), chosen["relevance"] > 0).when(~relevant, F.lit(False))
    text = F.coalesce("response_text", F.lit(""))
    missing = F.when(F.col("_recorded").isNull(), F.lit("no response recorded"))
    error = F.coalesce("request_error", missing)

    def answered(value: Column) -> Column:
        return F.when(error.isNull(), value)

    rows = read.select(
        "run_id",
        F.lit(now).alias("ts"),
        "model",
        (F.lit(None).cast("string") if reasoning is None else reasoning).alias("reasoning"),
        "query_id",
        "query_text",
        F.lit(k).alias("k"),
        F.when(error.isNull(), retrieved_json(F.col("_hits"))).otherwise(F.lit("[]")).alias(
            "retrieved"
        ),
        answered(F.when(F.col("_read.valid"), text)).alias("response_json"),
        answered(text).alias("response_text"),
        answered(F.col("_read.selected_index")).alias("selected_index"),
        answered(picked).alias("selected_doc_id"),
        F.when(error.isNull(), F.col("_read.parse_error"))
        .otherwise(F.concat(F.lit("request_error: "), error))
        .alias("parse_error"),
        answered(relevant).alias("any_relevant_in_topk"),
        answered(correct).alias("correct"),
        answered(F.col("prompt_tokens")).alias("usage_prompt_tokens"),
        answered(F.col("reasoning_tokens")).alias("usage_reasoning_tokens"),
        answered(F.col("completion_tokens")).alias("usage_completion_tokens"),
        "latency_ms",
    )
    return conform(rows, RESULTS)
