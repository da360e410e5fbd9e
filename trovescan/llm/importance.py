"""Drawing the documents that look most like a target, by hashed n-gram importance (operator 12)."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovescan.llm.byte_words import runs, word_lists
from trovescan.llm.registry import query, table
from trovescan.operators.ids import assign_ids
from trovescan.session import materialize

BUCKETS = 10_000
SIZE = 1
SEED = 2024
PERCENT = 10
MIN_WORDS = 20
#: Scores are counted in so many ranges at a time to find the one where the draw ends.
RANGES = 1 << 14


def feature_counts(text: bytes | None, size: int) -> Iterator[Counter]:
    """Counts of the crc32 of all runs of 1 to ``size`` words, joined by a blank, for each piece of a text.

    The crc32 of a run is the seed from which that of the run with one more word goes on. Runs that begin in one
    piece and end in the next count with the latter.
    """
    before: list[bytes] = []
    for own in word_lists(text):
        yield Counter({zlib.crc32(word): n for word, n in Counter(own).items()}) if size == 1 else _runs(before, own, size)
        before = (before + own)[-(size - 1) :] if size > 1 else []


def _runs(before: list[bytes], own: list[bytes], size: int) -> Counter:
    words = before + own
    counts: Counter = Counter()
    seeds = [zlib.crc32(word) for word in words]
    for n in range(1, size + 1):
        if n > 1:
            seeds = [zlib.crc32(b" " + word, seed) for seed, word in zip(seeds, words[n - 1 :], strict=False)]
        counts.update(seeds[max(0, len(before) - n + 1) :])  # runs that end in this piece
    return counts


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, size: int = SIZE) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket. Every task sends at most ``buckets`` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for counts in feature_counts(text.as_py(), size):
                    keys = np.fromiter(counts.keys(), np.int64, len(counts)) % buckets
                    np.add.at(total, keys, np.fromiter(counts.values(), np.int64, len(counts)))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], names=["bucket", "n"])

    counted = docs.select(F.col(f"`{text_col}`").cast("binary")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """What a feature of each bucket adds to a weight: 1000 times the log of target over raw share, add-one smoothed."""
    def dense(counts: DataFrame) -> list[int]:
        own = {r["bucket"]: r["n"] for r in counts.collect()}  # at most ``buckets`` rows
        return [own.get(b, 0) for b in range(buckets)]

    s, t = dense(raw), dense(target)
    of_s, of_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return [math.floor(1000 * math.log(float(b + 1) * of_s / (float(a + 1) * of_t))) for a, b in zip(s, t, strict=True)]


def noise(seed: int, key: str) -> int:
    """Gumbel noise of a document, in thousandths, from a hash of its id alone."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def importance(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    buckets: int = BUCKETS,
    size: int = SIZE,
    seed: int = SEED,
    keep: list[str] | None = None,
) -> DataFrame:
    """Weigh every document by how much more often its features occur in the target than among all documents.

    Two passes over the texts: bucket counts of both tables (``buckets`` sums, added up in each task before they
    are moved), then the sum of gains of each document. Words are lower-cased for A-Z only.

    Returns the columns ``keep`` (all, by default), n_words, n_features, weight, and score: the weight plus Gumbel
    noise, so that the highest scores are a draw without replacement in proportion to the weights' exponentials.
    A null, empty or wordless text has no features and weight 0; a null id is hashed as an empty one; rows that
    share an id share their noise; texts of any length are read by pieces; empty tables are allowed on both sides
    (all gains are then smoothed); a column named like one of the four gives way to it.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, size), bucket_counts(target, target_col, buckets, size), buckets)
    added = ["n_words", "n_features", "weight", "score"]
    columns = [c for c in (docs.columns if keep is None else keep) if c not in added]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain_of = _Gains(gain)
        for batch in batches:
            texts = batch.column("text")
            for begin, end in runs(texts):
                found = [_weight(texts[i].as_py(), size, gain_of) for i in range(begin, end)]
                noises = [noise(seed, key or "") for key in batch.column("key")[begin:end].to_pylist()]
                words, features, weights = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row")[begin:end], pa.array(words, pa.int64()), pa.array(features, pa.int64()),
                        pa.array(weights, pa.int64()), pa.array([w + g for w, g in zip(weights, noises, strict=True)], pa.int64()),
                    ],
                    names=["row", *added],
                )

    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{id_col}`").cast("string").alias("key"),
        F.col(f"`{text_col}`").cast("binary").alias("text"),
    )
    kind = rows.schema["row"].dataType.simpleString()
    scored = rows.mapInArrow(weigh, f"row {kind}, n_words long, n_features long, weight long, score long")
    return scored.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], *added)


class _Gains(dict):
    """The gain of a word, kept for the words met lately. One object belongs to one task."""

    def __init__(self, gain: list[int]):
        super().__init__()
        self.gain = gain

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = own = self.gain[zlib.crc32(word) % len(self.gain)]
        return own


def _weight(text: bytes | None, size: int, gain_of: _Gains) -> tuple[int, int, int]:
    """Words, features, and the sum of their gains."""
    if size == 1:
        words = weight = 0
        for own in word_lists(text):
            words += len(own)
            weight += sum(map(gain_of.__getitem__, own))
        return words, words, weight
    words = sum(map(len, word_lists(text)))
    features = weight = 0
    for counts in feature_counts(text, size):
        features += counts.total()
        weight += sum(n * gain_of.gain[key % len(gain_of.gain)] for key, n in counts.items())
    return words, features, weight


def lowest_drawn(scores: DataFrame, wanted: int, ranges: int = RANGES) -> int:
    """The ``wanted``-th highest score, by counts of ever finer ranges, without sorting. ``scores`` has at least so many rows."""
    lo, hi = scores.agg(F.min("score"), F.max("score")).first()
    while lo < hi:
        width = -(-(hi - lo + 1) // ranges)
        inside = scores.where(F.col("score").between(lo, hi))
        counted = inside.groupBy(F.floor((F.col("score") - lo) / width).alias("at")).count()
        for at, n in sorted(((r["at"], r["count"]) for r in counted.collect()), reverse=True):  # at most ``ranges`` rows
            if n >= wanted:
                lo, hi = lo + at * width, min(hi, lo + (at + 1) * width - 1)
                break
            wanted -= n
    return lo


def draw(
    scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, id_col: str = "doc_id"
) -> DataFrame:
    """Rank the ``percent`` of the documents of ``min_words`` words or more that have the highest scores.

    ``rank`` counts from 1 by descending score, ties by ascending id (null first), then by features and weight;
    all other rows have a null rank. The share is of the documents that qualify, rounded down. The lowest score
    drawn is found by counting ranges; only rows at or above it are sorted, by a range shuffle whose key is
    unique, so neither ties nor repeated rows gather in a task. An empty table gives no rows; a column named rank
    gives way.
    """
    rows = scored.drop("rank").withColumn("_row", F.monotonically_increasing_id())
    rows = materialize(rows, "scores")
    enough = rows.where(F.col("n_words") >= min_words)
    wanted = enough.count() * percent // 100
    columns = [c for c in scored.columns if c != "rank"]
    if not wanted:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    least = lowest_drawn(enough, wanted)
    high = (F.col("n_words") >= min_words) & (F.col("score") >= least)
    order = ["_low", "_id", "_features", "_weight", "_row"]
    sorted_by = {"_low": -F.col("score"), "_id": F.col(f"`{id_col}`"), "_features": F.col("n_features"), "_weight": F.col("weight")}
    ranked = assign_ids(rows.where(high).withColumns(sorted_by), order, id_column="rank")
    drawn = F.when(F.col("rank") <= wanted, F.col("rank")).cast("long").alias("rank")
    rest = rows.where(~high).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, drawn).unionByName(rest)


@query(
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents
    ), dw AS (
      SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY ALL
    ), bw AS (
      SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark) GROUP BY ALL
    ), v AS (
      SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, strlen(word)),
          lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
          lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))),
        4294967295::BIGINT) % 10000 AS bucket
      FROM (SELECT word FROM dw UNION SELECT word FROM bw)
    ), s AS (SELECT bucket, sum(n) AS s FROM dw JOIN v USING (word) GROUP BY bucket
    ), t AS (SELECT bucket, sum(n) AS t FROM bw JOIN v USING (word) GROUP BY bucket
    ), g AS (
      SELECT word, floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)
        / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)))) AS gain
      FROM v LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
    ), w AS (
      SELECT r, CAST(sum(n * gain) AS BIGINT) AS weight FROM dw JOIN g USING (word) GROUP BY r
    ), x AS (
      SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT
          + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM d LEFT JOIN w USING (r)
    ), k AS (
      SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place FROM x
    )
    SELECT doc_id, n_features, weight, score,
      CASE WHEN n_features >= 20 AND place <= (SELECT count(*) FROM x WHERE n_features >= 20) * 10 // 100 THEN place END AS rank
    FROM k
    """
)
def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its likeness to the benchmark, and its rank if it is drawn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = importance(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return draw(scored).select("doc_id", "n_features", "weight", "score", "rank")
