"""Ordering candidates anew by a score of (query text, document text)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from trovescan.functions.text import words
from trovescan.operators.hits import fetch_doc_texts, listed_ids, rerank_depth
from trovescan.session import materialize

#: Pairs of one document that meet its words in one task.
PAIRS_PER_PART = 10_000
HOT_DOCUMENTS = 100_000
#: Texts or words of the queries that are broadcast at a time.
ROUND_BYTES = 32 << 20
Scorer = Callable[[list[tuple[str, str]]], Sequence[float]]


def rerank(pairs: DataFrame, score: Column, k: int, candidates: int | None = None) -> DataFrame:
    """The k best of the first candidates of each query by ``score``, highest first.

    ``rank`` becomes the new place; ``score`` stays the distance. Fifty candidates
    are looked at by default, or k if that is more.
    """
    candidates = rerank_depth(k, candidates)
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "faiss_id")
    return (
        pairs.where(F.col("rank") <= candidates)
        .withColumn("rerank_score", score)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def word_share(asked: Column, held: Column) -> Column:
    """Share of the distinct query words found among the words of a text; 0 without words."""
    found = F.size(F.array_intersect(asked, held))
    return F.when(F.size(asked) > 0, found / F.size(asked)).otherwise(F.lit(0.0))


def rerank_lexical(
    hits: DataFrame,
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    candidates: int | None = None,
    pairs_per_part: int = PAIRS_PER_PART,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """Rerank by shared words: the stand-in for a neural scorer, inside the JVM.

    Each text is split once, not once per pair: only the documents that are
    candidates at all, and no words travel with the pairs (``pair_rounds``).
    The candidates are stored once, as both the texts and the pairs come from them.
    """
    near = materialize(hits.where(F.col("rank") <= rerank_depth(k, candidates)), "candidates", release=True)
    none = F.array().cast("array<string>")

    def with_words(listed: DataFrame) -> DataFrame:
        held = fetch_doc_texts(docs, listed_ids(listed)).select("doc_id", F.array_distinct(words(F.col("text"))).alias("_held"))
        return listed.join(held, "doc_id", "left").withColumn("_held", F.coalesce("_held", none))

    asked = queries.select("query_id", F.array_distinct(words(F.col("text"))).alias("_asked"))
    share = word_share(F.col("_asked"), F.col("_held"))
    rounds = pair_rounds(near, asked, with_words, pairs_per_part, round_bytes)
    scored = [pairs.withColumn("_share", share).drop("_held", "_asked") for pairs in rounds]
    return rerank(scored[0] if len(scored) == 1 else in_turn(scored), F.col("_share"), k, candidates).drop("_share", "_part")


def pair_rounds(
    near: DataFrame,
    asked: DataFrame,
    attach: Callable[[DataFrame], DataFrame],
    pairs_per_part: int = PAIRS_PER_PART,
    round_bytes: int = ROUND_BYTES,
) -> list[DataFrame]:
    """The stored pairs with what belongs to their queries and documents, some queries at a time.

    ``asked`` has the columns of a query, and ``attach`` gives the rows of a table their documents' columns, by
    ``doc_id``. A document is stored once with the list of its pairs (once for every ``pairs_per_part`` of
    them if these are very many, see ``_part``), and each round reads it where it lies; the queries of a round,
    about ``round_bytes`` of them, are broadcast. So no text moves with a pair. Pairs of unknown queries
    are left out. The rounds are plans: use one after the other (``in_turn``).
    """
    asked, rounds = _dealt(asked, round_bytes)
    near = near.withColumn("_round", _round_of(rounds))
    listed = _listed(near, pairs_per_part)
    held = attach(listed)
    if "_part" in listed.columns:
        held = held.repartition("doc_id", "_part")
    if rounds > 1:
        held = materialize(held, "asked-documents", release=True)
    own = [c for c in held.columns if c not in ("doc_id", "_pairs")]
    names = [c for c in near.columns if c not in ("query_id", "doc_id", "_round")]

    def turn(number: int) -> DataFrame:
        some = F.filter("_pairs", lambda pair: pair["_round"] == number) if rounds > 1 else F.col("_pairs")
        pairs = held.withColumn("_pair", F.explode(some)).select("_pair.query_id", "doc_id", *[f"_pair.{c}" for c in names], *own)
        return pairs.join(F.broadcast(asked.where(F.col("_round") == number).drop("_round")), "query_id")

    return [turn(number) for number in range(rounds)]


def in_turn(rounds: list[DataFrame]) -> DataFrame:
    """All rounds together, each stored before the next one begins."""
    return reduce(DataFrame.unionByName, [materialize(pairs, "scored", release=True) for pairs in rounds])


def _round_of(rounds: int) -> Column:
    return F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.lit(rounds)).cast("int")


def _dealt(asked: DataFrame, round_bytes: int) -> tuple[DataFrame, int]:
    """The queries, stored, with their ``_round``, and the number of rounds; beyond one, a round's queries lie together."""
    asked = materialize(asked, "queries", release=True)
    total = asked.agg(F.coalesce(F.sum(sum(map(_bytes, asked.schema))), F.lit(0))).first()[0]
    rounds = max(1, -(-total // round_bytes))
    dealt = asked.withColumn("_round", _round_of(rounds))
    if rounds > 1:
        dealt = materialize(dealt.repartition(rounds, "_round").sortWithinPartitions("_round"), "queries", release=True)
    return dealt, rounds


def _bytes(field: StructField) -> Column:
    """About what a value takes in a broadcast row."""
    kind, value = field.dataType.simpleString(), F.col(f"`{field.name}`")
    if kind == "array<string>":
        size = F.octet_length(F.array_join(value, "")) + 12 * F.size(value)
    else:
        size = F.octet_length(value) if kind == "string" else F.lit(0)
    return F.coalesce(size, F.lit(0)) + 16


def _listed(near: DataFrame, pairs_per_part: int) -> DataFrame:
    """A stored row for each document, null too, with its pairs in ``_pairs``; several with ``_part`` if it has very many."""
    total = near.count()
    # At most HOT_DOCUMENTS documents have so many pairs, so their list can be broadcast.
    least = max(pairs_per_part, total // HOT_DOCUMENTS) + 1
    often = near.groupBy("doc_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    parts = materialize(often.select(F.col("doc_id").alias("_often"), F.ceil(F.col("_n") / pairs_per_part).cast("int").alias("_parts")), "hot")
    keys, pair = ["doc_id"], F.struct(*[c for c in near.columns if c != "doc_id"])
    if not parts.isEmpty():
        part = F.coalesce(F.pmod(F.xxhash64("query_id"), F.col("_parts")), F.lit(0)).cast("int")
        hot = F.broadcast(parts)
        near = near.join(hot, near["doc_id"].eqNullSafe(hot["_often"]), "left").withColumn("_part", part)
        keys.append("_part")
    return materialize(near.groupBy(*keys).agg(F.collect_list(pair).alias("_pairs")), "pairs-of-documents", release=True)


def rerank_with(
    pairs: DataFrame | list[DataFrame],
    load: Callable[[], Scorer],
    k: int,
    candidates: int | None = None,
    batch_rows: int = 256,
    keep: list[str] | None = None,
) -> DataFrame:
    """Rerank by a user's scorer of (query text, full text) pairs.

    ``load`` is called once per task and returns the scorer. With ``keep``, only these columns of the pairs
    (with query_id, faiss_id and rank) come out, and no text travels beyond the scorer. Pairs in rounds
    (``pair_rounds``) are scored and stored one round after the other.
    """
    rounds = [pairs] if isinstance(pairs, DataFrame) else pairs
    kept = rounds[0].columns if keep is None else keep
    rounds = [some.select(*dict.fromkeys([*kept, "query_text", "full_text"])) for some in rounds]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in rounds[0].select(*kept).schema]
        + ["_given double"]
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for batch in batches:
            for at in range(0, len(batch), batch_rows):
                part = batch.iloc[at : at + batch_rows].copy()
                texts = zip(part["query_text"].fillna(""), part["full_text"].fillna(""))
                part["_given"] = [float(x) for x in scorer(list(texts))]
                yield part[[*kept, "_given"]]

    depth = rerank_depth(k, candidates)
    scored = [some.where(F.col("rank") <= depth).mapInPandas(score, schema) for some in rounds]
    return rerank(scored[0] if isinstance(pairs, DataFrame) else in_turn(scored), F.col("_given"), k, candidates).drop("_given")
