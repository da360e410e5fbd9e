"""Mixing sources to target weights by nested hash thresholds (operator 6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trovescan.llm.registry import query, table
from trovescan.session import materialize

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_REPEATS = 2

_WORD = r"[^\x20\x09-\x0D]+"
#: A document's place in [0, 2 ** 48): four levels of 4096 buckets.
_BITS, _LEVELS = 12, 4


def source_targets(totals: DataFrame, weights: Sequence[float], share: float, max_repeats: float) -> DataFrame:
    """Adds the target of every source to (source, source_size): one row per source, so one task will do.

    Sources in code point order, null last, get the weights in turn. A target is weight x level, or
    ``max_repeats`` times the source's size if that is less. The level is found in one pass over the
    sources by the ratio at which they reach that bound: it is the first one, with all sources before
    it at their bounds, that the next source can take.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", "nr")
    whole = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("nr") - 1, len(weights)).cast("int") + 1)
    before = F.sum("bound").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    return (
        totals.withColumn("nr", F.row_number().over(by_name))
        .withColumn("weight", weight)
        .withColumn("bound", F.lit(float(max_repeats)) * F.col("source_size"))
        .withColumn("ratio", F.col("bound") / F.col("weight"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(whole))
        .withColumn("level", (F.col("total") - F.coalesce(before, F.lit(0.0))) / rest)
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "nr", "level"))).over(whole)["level"])
        .withColumn("target", F.coalesce(F.least(F.col("weight") * F.col("level"), F.col("bound")), F.col("bound")))
        .select("source", "source_size", "target")
    )


def _thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole copies of all, and the place up to which documents get one copy more."""
    found = targets.withColumn(
        "copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    ).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    found = found.withColumn("bound", F.lit(0).cast("long"))
    for level in range(1, _LEVELS + 1):
        shift = _BITS * (_LEVELS - level)
        step = found.select(F.col("source").alias("s"), "bound", "budget")
        inside = sized.join(step, F.col("source").eqNullSafe(F.col("s")))
        if level > 1:  # only the bucket in which the budget ends
            inside = inside.where(F.shiftright("place", shift + _BITS) == F.col("bound"))
        buckets = inside.groupBy("s", "budget", F.shiftright("place", shift).alias("b")).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")
        )
        upto = F.sum("words").over(Window.partitionBy("s").orderBy("b"))
        edge = (
            buckets.withColumn("upto", upto)
            .where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("words") <= F.col("budget")))
            .select(
                F.col("s").alias("s2"),
                F.col("b"),
                (F.col("budget") - F.col("upto") + F.col("words")).alias("left"),
                F.col("words"),
                F.col("rows"),
            )
        )
        found = found.select("source", "source_size", "target", "copies").join(edge, F.col("source").eqNullSafe(F.col("s2")), "left").select(
            "source", "source_size", "target", "copies",
            F.coalesce("b", F.lit(-1).cast("long")).alias("bound"),
            F.coalesce("left", F.lit(0.0)).alias("budget"),
            F.coalesce("words", F.lit(0).cast("long")).alias("words"),
            F.coalesce("rows", F.lit(0).cast("long")).alias("rows"),
        )
    return found


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def place_of(key) -> F.Column:
    """48 bits of the digest of a document's id: its place in its source."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, _BITS * _LEVELS // 4), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_repeats: float = MAX_REPEATS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Take words of every source near its target, whole documents at a time, without sorting them.

    A first job writes the size and the place of every document. Words are summed by source and bucket
    of places; where the budget ends, only that bucket is split further, four times in all. The bounds
    are one row per source, joined to the documents: every document is taken as often as its source
    goes whole into the target, and once more if its place is below the source's bound. A single
    document at the bound is taken if at least half of it fits; of several with the same place (rows
    that share an id) each gives the same share of its words.

    Returns ``id_col``, source, size, source_size, target, copies (whole ones), taken, and the columns
    of ``keep``. Null texts have size 0; null ids share a place; null sources form one source, the last;
    repeated rows count as often as they occur; an empty table gives no rows. Reruns agree.
    """
    row = [F.col(id_col).alias("id"), F.col(source_col).alias("source")]
    sized = materialize(docs.select(*row, word_count(text_col).alias("size"), place_of(id_col).alias("place")), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(totals, weights, share, max_repeats), "targets")
    bounds = materialize(_thresholds(sized, targets), "bounds").withColumnRenamed("source", "bound_source")
    if keep:
        rows = docs.select(*row, word_count(text_col).alias("size"), place_of(id_col).alias("place"), F.struct(*keep).alias("kept"))
    else:
        rows = sized.withColumn("kept", F.lit(None))
    one = (F.col("place") == F.col("bound")) & (F.col("rows") == 1) & (2 * F.col("budget") >= F.col("size"))
    more = (F.col("place") < F.col("bound")) | one
    part = F.when(
        (F.col("place") == F.col("bound")) & (F.col("rows") > 1),
        F.floor(F.col("size") * F.col("budget") / F.col("words")),
    ).otherwise(0)
    copies = (F.col("copies") + more.cast("long")).cast("long")
    return rows.join(bounds, F.col("source").eqNullSafe(F.col("bound_source"))).select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target",
        copies.alias("copies"),
        (copies * F.col("size") + part).cast("long").alias("taken"),
        *([F.col(f"kept.{c}").alias(c) for c in keep if c not in (id_col, "source")] if keep else []),
    )


@query(
    r"""
    WITH d AS (
      SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS place
      FROM documents
    ), s AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nr
      FROM d GROUP BY source
    ), w AS (
      SELECT *, [3.0::DOUBLE, 1.0, 2.0][CAST((nr - 1) % 3 + 1 AS INT)] AS weight, 2.0::DOUBLE * source_size AS bound,
        1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS total
      FROM s
    ), r AS (
      SELECT *, bound / weight AS ratio,
        (total - coalesce(sum(bound) OVER (ORDER BY bound / weight, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(weight) OVER (ORDER BY bound / weight, nr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w
    ), l AS (
      SELECT level FROM r WHERE level <= ratio ORDER BY ratio, nr LIMIT 1
    ), t AS (
      SELECT source, source_size, coalesce(least(weight * (SELECT level FROM l), bound), bound) AS target FROM r
    ), b AS (
      SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t
    ), p AS (
      SELECT d.*, b.source_size, b.target, b.copies, b.target - b.copies * b.source_size AS budget,
        CAST(sum(size) OVER (PARTITION BY d.source ORDER BY place) AS BIGINT) AS upto,
        CAST(sum(size) OVER (PARTITION BY d.source, place) AS BIGINT) AS words,
        count(*) OVER (PARTITION BY d.source, place) AS n
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
    )
    SELECT doc_id, source, size, source_size, target,
      copies + CASE WHEN upto <= budget OR n = 1 AND upto - words <= budget AND 2 * (budget - upto + words) >= size
        THEN 1 ELSE 0 END AS copies,
      copies * size + CASE WHEN upto <= budget THEN size WHEN upto - words > budget THEN 0
        WHEN n > 1 THEN CAST(floor(size * (budget - upto + words) / words) AS BIGINT)
        WHEN 2 * (budget - upto + words) >= size THEN size ELSE 0 END AS taken
    FROM p
    """
)
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's target and the words that the mix takes of it."""
    return mix(table(spark, sf_dir, "documents"))
