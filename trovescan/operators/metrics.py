"""Judging ranked hits. One row per query, from one grouping of its hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovescan.functions.vectors import bind, total
from trovescan.operators.hits import judge_by, judge_hits, qrels_unique
from trovescan.session import materialize

# Guards against a zero sum and against the logarithm of zero.
SUM_GUARD = 1e-9
LOG_GUARD = 1e-12

#: So many latencies of a range are put in order in one task.
FEW_VALUES = 10_000


def hit_stats(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Mean, deviation and entropy of the scores, and the number of different titles.

    A query has at most k hits, so its scores fit in one array. Queries without
    hits count as one score of 0.
    """
    grouped = hits.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "score", "title"))).alias("_hits")
    )
    listed = queries.select("query_id").join(grouped, "query_id", "left")
    ordered = F.transform("_hits", lambda h: h["score"])
    titles = F.array_distinct(F.transform("_hits", lambda h: F.coalesce(h["title"], F.lit(""))))
    scores = F.coalesce(ordered, F.array(F.lit(0.0)))
    stats = bind(scores, lambda s: bind(total(s) / F.size(s), lambda mean: _spread(s, mean)))
    return listed.select(
        "query_id", stats.alias("_stats"), F.coalesce(F.size(titles), F.lit(0)).alias("unique_titles")
    ).select("query_id", "_stats.*", "unique_titles")


def _spread(scores: Column, mean: Column) -> Column:
    squares = F.transform(scores, lambda s: (s - mean) * (s - mean))
    entropy = bind(
        total(scores) + SUM_GUARD,
        lambda whole: F.lit(0.0)
        - total(F.transform(scores, lambda s: s / whole * F.log(s / whole + LOG_GUARD))),
    )
    return F.struct(
        mean.alias("score_mean"),
        F.sqrt(total(squares) / F.size(scores)).alias("score_std"),
        (entropy + 0.0).alias("score_entropy"),
    )


def _discounted(relevances: Column) -> Column:
    """Sum of (2^relevance - 1) / log2(place + 1) over an ordered array."""
    return total(
        F.transform(
            relevances,
            lambda rel, i: (F.pow(F.lit(2.0), rel) - 1.0) / F.log2(i + F.lit(2.0)),
        )
    )


def _ndcg(relevances: Column) -> Column:
    """Gain against the same relevances in the best order; 0 if none is relevant."""
    best = _discounted(F.sort_array(relevances, asc=False))
    return F.when(best > 0, _discounted(relevances) / best).otherwise(F.lit(0.0))


def _ranked_relevance(judged: DataFrame, k: int) -> DataFrame:
    grouped = (
        judged.where(F.col("rank") <= k)
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "relevance"))).alias("_hits"))
    )
    return grouped.select(
        "query_id", F.transform("_hits", lambda h: h["relevance"]).alias("relevances")
    )


def ndcg(hits: DataFrame, qrels: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """NDCG at k of each query; the ideal order is that of the retrieved hits."""
    ranked = _ranked_relevance(judge_hits(hits, qrels), k)
    listed = queries.select("query_id").join(ranked, "query_id", "left")
    return listed.select(
        "query_id", F.coalesce(_ndcg(F.col("relevances")), F.lit(0.0)).alias("ndcg")
    )


def relevant_totals(qrels: DataFrame) -> DataFrame:
    """How many documents are relevant to each query."""
    return _totals(qrels_unique(qrels))


def _totals(unique: DataFrame) -> DataFrame:
    relevant = F.count(F.when(F.col("relevance") > 0, True))
    return unique.groupBy("query_id").agg(relevant.alias("total_relevant"))


def retrieval_metrics(
    hits: DataFrame,
    qrels: DataFrame,
    queries: DataFrame,
    k: int,
    digits: int | None = 4,
) -> DataFrame:
    """Relevant hits, relevant documents, precision, recall and NDCG at k of each query.

    All queries are kept; those without hits or judgements get zeros. ``digits``
    rounds the three ratios, None leaves them. The judgements are collapsed
    once, and stored: both the hits and the totals are judged by them.
    """
    unique = materialize(qrels_unique(qrels), "judgements")
    ranked = _ranked_relevance(judge_by(hits, unique), k)
    listed = (
        queries.select("query_id")
        .join(ranked, "query_id", "left")
        .join(_totals(unique), "query_id", "left")
    )
    found = F.size(F.filter(F.coalesce("relevances", F.array().cast("array<int>")), lambda r: r > 0))
    total = F.coalesce("total_relevant", F.lit(0))
    ratios = {
        "precision": found / F.lit(max(1, k)),
        "recall": found / F.greatest(total, F.lit(1)),
        "ndcg": F.coalesce(_ndcg(F.col("relevances")), F.lit(0.0)),
    }
    return listed.select(
        "query_id",
        found.alias("relevant"),
        total.alias("total_relevant"),
        *[(F.round(v, digits) if digits is not None else v).alias(c) for c, v in ratios.items()],
    )


def latency_quantiles(
    results: DataFrame, quantiles: dict[str, float], few: int = FEW_VALUES, bins: int = 1024
) -> DataFrame:
    """Exact quantiles of each run's latency, interpolated between neighbours; nulls and NaN do not count.

    Equal latencies are counted first. Each place that a quantile needs starts with the range of its whole
    run; as long as a range holds more than ``few`` latencies, it is cut into ``bins``, their rows are counted, and
    the bin that holds the place becomes the range. Then at most ``few`` values are put in order. So a run of any
    size is counted by all tasks and sorted by none. Ranges too wide or too narrow for that are cut at their ends.
    """
    run = ["run_id", "model"]
    held = results.where("latency_ms IS NOT NULL AND NOT isnan(latency_ms)")
    counts = held.groupBy(*run, F.col("latency_ms").alias("value")).agg(F.count("*").alias("n"))
    counts = materialize(counts, "latencies")
    low, high = F.min("value").alias("low"), F.max("value").alias("high")
    runs = counts.groupBy(*run).agg(F.sum("n").alias("rows"), F.count("*").alias("values"), low, high)
    place = {name: F.lit(float(q)) * (F.col("rows") - 1) for name, q in quantiles.items()}
    places = F.array_distinct(F.array(*[end(p).cast("bigint") for p in place.values() for end in (F.floor, F.ceil)]))
    asked = runs.select(*run, "values", "low", "high", F.lit(0).cast("bigint").alias("before"), F.explode(places).alias("place"))
    asked = materialize(asked, "places")
    settled = asked.where(_settled(few))
    wide = asked.where(~_settled(few))
    while not wide.isEmpty():
        wide = materialize(_narrowed(counts, wide, bins), "places")
        settled = settled.unionByName(wide.where(_settled(few)))
        wide = wide.where(~_settled(few))

    own = _same_run(counts, settled).groupBy(*run, "place", "before", "value").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*run, "place").orderBy("value")) + F.col("before")
    found = own.withColumn("upto", upto).where(F.col("upto") > F.col("place"))
    found = found.groupBy(*run, "place").agg(F.min("value").alias("value"))
    found = found.groupBy(*run).agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("at"))
    value = lambda p, end: F.col("at")[end(p).cast("bigint")]

    def between(p: Column) -> Column:
        first, second = value(p, F.floor), value(p, F.ceil)
        return F.when(first == second, first).otherwise(first + (second - first) * (p - F.floor(p)))

    sizes = runs.select(F.col("run_id").alias("_run"), F.col("model").alias("_model"), "rows")
    same = F.col("run_id").eqNullSafe(F.col("_run")) & F.col("model").eqNullSafe(F.col("_model"))
    return found.join(sizes, same).select(*run, *[between(p).alias(name) for name, p in place.items()])


def _settled(few: int) -> Column:
    return (F.col("values") <= few) | (F.col("low") == F.col("high"))


def _same_run(counts: DataFrame, places: DataFrame) -> DataFrame:
    """The latencies of each run that lie in the range of each of its places."""
    asked = places.select(F.col("run_id").alias("_run"), F.col("model").alias("_model"), "low", "high", "before", "place")
    same = F.col("run_id").eqNullSafe(F.col("_run")) & F.col("model").eqNullSafe(F.col("_model"))
    inside = F.col("value").between(F.col("low"), F.col("high"))
    return counts.join(asked, same & inside).drop("_run", "_model")


def _narrowed(counts: DataFrame, wide: DataFrame, bins: int) -> DataFrame:
    """Each place with the bin of its range that holds it. Both ends of a range lie in different bins."""
    run = ["run_id", "model"]
    span = F.col("high") / 2 - F.col("low") / 2  # halves, so that it does not overflow
    step = F.try_divide(F.col("value") / 2 - F.col("low") / 2, span)
    endless = (span == float("inf")) | (span == 0)
    by_kind = F.when(F.col("value") == F.col("low"), 0).when(F.col("value") == F.col("high"), 2).otherwise(1)
    inner = F.least(F.floor(step * bins), F.lit(bins - 1)).cast("int")
    ranged = _same_run(counts, wide).withColumn("bin", F.when(endless, by_kind).otherwise(inner))
    binned = ranged.groupBy(*run, "place", "before", "bin").agg(
        F.sum("n").alias("n"), F.count("*").alias("values"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    upto = F.sum("n").over(Window.partitionBy(*run, "place").orderBy("bin"))  # at most ``bins`` rows
    counted = binned.withColumn("upto", F.col("before") + upto).withColumn("before", F.col("upto") - F.col("n"))
    mine = (F.col("before") <= F.col("place")) & (F.col("place") < F.col("upto"))
    return counted.where(mine).select(*run, "values", "low", "high", "before", "place")


_SUMMED = [
    "run_id", "model", "correct", "any_relevant_in_topk", "parse_error", "usage_prompt_tokens",
    "usage_reasoning_tokens", "usage_completion_tokens", "latency_ms",
]


def run_summary(results: DataFrame, prices: DataFrame) -> DataFrame:
    """Totals of each run: correctness, errors, tokens, cost and latency."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    results = materialize(results.select(*_SUMMED), "results")  # read for the totals and for the quantiles
    per_run = results.groupBy("run_id", "model").agg(
        F.count("*").alias("queries"),
        rate("correct").alias("correct_rate"),
        rate("any_relevant_in_topk").alias("relevant_rate"),
        F.count("parse_error").alias("parse_errors"),
        F.sum("usage_prompt_tokens").alias("prompt_tokens"),
        F.sum("usage_reasoning_tokens").alias("reasoning_tokens"),
        F.sum("usage_completion_tokens").alias("completion_tokens"),
    )
    slow = latency_quantiles(results, {"latency_p50": 0.5, "latency_p95": 0.95}).select(
        F.col("run_id").alias("_run"), F.col("model").alias("_model"), "latency_p50", "latency_p95"
    )
    same = F.col("run_id").eqNullSafe(F.col("_run")) & F.col("model").eqNullSafe(F.col("_model"))
    per_run = per_run.join(slow, same, "left").drop("_run", "_model")
    cost = (
        F.col("prompt_tokens") * F.col("cost_per_mtok_in")
        + F.col("completion_tokens") * F.col("cost_per_mtok_out")
    ) / 1e6
    return (
        per_run.join(prices.withColumnRenamed("name", "model"), "model", "left")
        .withColumn("cost", cost)
        .drop("tier", "cost_per_mtok_in", "cost_per_mtok_out")
    )
