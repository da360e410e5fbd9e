"""Removal of lines, paragraphs or longer passages that repeat across documents (operator 8)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trovescan.llm.byte_words import TABLE, runs
from trovescan.llm.registry import query, table
from trovescan.session import materialize

SEPARATORS = {"line": "\n", "paragraph": "\n\n"}
#: Units with fewer words are left alone: short lines repeat by chance.
MIN_WORDS = 8
#: The units of a digest are dealt to so many tasks when they meet its first place.
SALT = 16

#: Words of adjacent repeated clauses that make a passage.
MIN_PASSAGE = 40
#: Digests (of 8 bytes) that are sent to every task.
MAX_BROADCAST = 4_000_000

#: Units of one digest that may meet in one task.
HOT_UNITS = 1_000
HOT_DIGESTS = 50_000

_CLAUSE = re.compile(r"[^.!?,;:\n]+")
_BLANKS = re.compile(r"[ \t\r\n\f\v]+")


def normalise(unit: str) -> str:
    return _BLANKS.sub(" ", unit.lower()).strip(" ")


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str = "line",
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """Keep the first occurrence of every unit of ``min_words`` words or more, and cut the others out.

    Units are compared by the 128-bit digest of their lower-case words; occurrences are ranked by
    document id, then by their number in the document. Tasks reduce each digest to its first place and
    its count before the shuffle; only digests seen more than once come back to the units, dealt out by
    salt, so that a common line is spread. Documents are joined once with the units to cut.

    Returns the columns of ``docs``, the text without the units cut (joined by the separator again), and
    removed: array of (start, end), code points in the original text, end exclusive, in order. A null
    text stays null and an empty one empty, with nothing removed; rows that share an id and a text are
    one document stated more than once and are cut alike; a null id ranks first; an empty table gives
    no rows; all other columns pass through, but one named removed, which gives way.
    """
    separator = SEPARATORS[unit]
    kind = docs.schema[id_col].dataType.simpleString()

    def split(batches):
        for batch in batches:
            rows, numbers, starts, ends, digests = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                at = 0
                for number, piece in enumerate((text or "").split(separator)):
                    plain = normalise(piece)
                    if plain.count(" ") + 1 >= min_words:
                        rows.append(i)
                        numbers.append(number)
                        starts.append(at)
                        ends.append(at + len(piece))
                        digests.append(hashlib.blake2b(plain.encode(), digest_size=16).digest())
                    at += len(piece) + len(separator)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(take), batch.column("version").take(take), pa.array(numbers, pa.int32()),
                    pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(digests, pa.binary()),
                ],
                names=["id", "version", "number", "start", "end", "digest"],
            )

    version = F.xxhash64(F.col(text_col))
    units = docs.select(F.col(id_col).alias("id"), version.alias("version"), F.col(text_col).alias("text")).mapInArrow(
        split, f"id {kind}, version long, number int, start long, end long, digest binary"
    )
    place = F.struct("id", "number", "version")
    repeated = (
        units.groupBy("digest")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(F.col("first") != F.col("last"))
        .select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    )
    cuts = (
        units.withColumn("salt", F.pmod(F.xxhash64("id", "number"), F.lit(SALT)).cast("int"))
        .join(repeated, ["digest", "salt"])
        .where(~F.struct("id", "number", "version").eqNullSafe(F.col("first")))
        .groupBy("id", "version")
        .agg(F.array_sort(F.collect_set(F.struct("start", "end", "number"))).alias("cuts"))
        .select(F.col("id").alias("_id"), F.col("version").alias("_version"), "cuts")
    )

    @F.pandas_udf("string")
    def without(texts: pd.Series, cut: pd.Series) -> pd.Series:
        out = []
        for text, numbers in zip(texts, cut, strict=True):
            if numbers is not None and text is not None:
                gone = set(numbers)
                text = separator.join(u for n, u in enumerate(text.split(separator)) if n not in gone)
            out.append(text)
        return pd.Series(out, dtype=object)

    removed = F.coalesce(
        F.transform("cuts", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))),
        F.lit([]).cast("array<struct<start:bigint,end:bigint>>"),
    )
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("key"), version.alias("digest"))
    joined = rows.join(cuts, F.col("key").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_version")), "left")
    text = without(F.col(f"row.`{text_col}`"), F.transform("cuts", lambda c: c["number"]))
    kept = [c for c in docs.columns if c != "removed"]
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in kept], removed.alias("removed"))


def clauses(text: str | None) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each stretch between punctuation marks or line breaks that has words."""
    for found in _CLAUSE.finditer(text or ""):
        words = found[0].encode("utf-8", "replace").translate(TABLE).split()
        if words:
            yield found.start(), found.end(), len(words), hashlib.blake2b(b" ".join(words), digest_size=8).digest()


def remove_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_PASSAGE,
    max_broadcast: int = MAX_BROADCAST,
    hot_units: int = HOT_UNITS,
) -> DataFrame:
    """Keep the first occurrence of every passage, and cut out later ones, wherever they begin in a line.

    Units are clauses: what stands between ``. ! ? , ; :`` and line breaks, compared by the 64-bit digest of their
    words in lower case, so that their borders come from the text and not from its lines. Occurrences are ranked
    by document id, then by their number in the document; every unit but the first of its kind is a repeat. Adjacent
    repeats are one passage, and it is cut if it has at least ``min_words`` words: single clauses repeat by chance,
    and stay. What a copied passage has before its first mark and after its last one stays as well.

    Digests are counted first, added up in each task. Only units whose digest occurs twice are emitted with their
    places: up to ``max_broadcast`` such digests are sent to every task, more are joined by shuffle. Units of a digest
    that has more than ``hot_units`` of them meet its first place where they lie.

    Returns the columns of ``docs``, the text without its passages, and removed: array of (start, end), code
    points in the original text, end exclusive, in order. Null and empty texts, rows that share an id and a text, a null
    id, empty tables and clashing names are treated as ``remove_repeats`` does; texts of any length are read whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    version = F.xxhash64(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("id"), version.alias("version"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in runs(batch.column("text")):
                own = [c[3] for text in batch.column("text")[begin:end] for c in clauses(text.as_py())]
                keys, n = np.unique(np.frombuffer(b"".join(own), "<i8"), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n, pa.int64())], names=["digest", "n"])

    counted = texts.select("text").mapInArrow(count, "digest long, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    twice = materialize(counted.where("n > 1"), "repeated")
    n_digests, n_units = twice.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    few = n_digests <= max_broadcast
    known = docs.sparkSession.sparkContext.broadcast(np.sort(twice.toArrow()["digest"].to_numpy())) if few else None
    # At most HOT_DIGESTS digests have so many units: a line or passage that stands in very many documents.
    hot = materialize(twice.where(F.col("n") > max(hot_units, n_units // HOT_DIGESTS)).select("digest"), "hot")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in runs(batch.column("text")):
                rows, numbers, found = [], [], []
                for i in range(begin, end):
                    own = list(clauses(batch.column("text")[i].as_py()))
                    rows += [i] * len(own)
                    numbers += range(len(own))
                    found += own
                digests = np.frombuffer(b"".join([f[3] for f in found]), "<i8")
                kept = np.arange(len(digests))
                if known is not None:
                    at = np.searchsorted(known.value, digests)
                    kept = np.flatnonzero(np.append(known.value, 0)[at] == digests) if len(known.value) else kept[:0]
                take = pa.array(np.array(rows, np.int64)[kept])
                columns = [np.array([f[j] for f in found], np.int64)[kept] for j in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(take), batch.column("version").take(take),
                        pa.array(np.array(numbers, np.int64)[kept]), *map(pa.array, columns), pa.array(digests[kept]),
                    ],
                    names=["id", "version", "number", "start", "end", "words", "digest"],
                )

    units = texts.mapInArrow(place, f"id {kind}, version long, number long, start long, end long, words long, digest long")
    if not few:
        units = units.join(twice.select("digest"), "digest", "left_semi")
    units = materialize(units.select("id", "version", "number", "start", "end", "words", "digest"), "units")
    at = F.struct("id", "number", "version")
    first = units.groupBy("digest").agg(F.min(at).alias("first"))
    common = F.broadcast(materialize(first.join(F.broadcast(hot), "digest"), "hot-first"))
    rest = units.join(F.broadcast(hot), "digest", "left_anti").join(first, "digest")
    later = rest.unionByName(units.join(common, "digest")).where(~at.eqNullSafe(F.col("first")))
    later = later.select("id", "version", "number", "start", "end", "words").dropDuplicates(["id", "version", "number"])
    own = Window.partitionBy("id", "version").orderBy("number")  # the units of one text
    passages = later.withColumn("passage", F.col("number") - F.row_number().over(own)).groupBy("id", "version", "passage").agg(
        F.sum("words").alias("words"), F.min("start").alias("start"), F.max("end").alias("end")
    )
    cuts = passages.where(F.col("words") >= min_words).groupBy("id", "version").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts")
    )
    cuts = cuts.select(F.col("id").alias("_id"), F.col("version").alias("_version"), "cuts")

    @F.pandas_udf("string")
    def without(texts: pd.Series, cut: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, cut, strict=True):
            if spans is not None and text is not None:
                ends = [0, *[s["end"] for s in spans]]
                text = "".join(text[i:j] for i, j in zip(ends, [*[s["start"] for s in spans], len(text)], strict=True))
            out.append(text)
        return pd.Series(out, dtype=object)

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("key"), version.alias("digest"))
    joined = rows.join(cuts, F.col("key").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_version")), "left")
    text = without(F.col(f"row.`{text_col}`"), F.col("cuts"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    kept = [c for c in docs.columns if c != "removed"]
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in kept], F.coalesce("cuts", none).alias("removed")
    )


@query(
    r"""
    WITH p AS (
      SELECT doc_id, unnest(pieces) AS piece, unnest(range(len(pieces))) AS k
      FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?,;:\n]+|[.!?,;:\n]+') AS pieces FROM documents)
    ), q AS (
      SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) - length(piece) AS start, regexp_extract_all(
        translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM p
    ), u AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS number FROM q WHERE len(w) > 0
    ), r AS (
      SELECT *, row_number() OVER (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id, number) > 1 AS again FROM u
    ), c AS (
      SELECT doc_id, min(start) AS start, max(start + length(piece)) AS "end"
      FROM (SELECT *, number - row_number() OVER (PARTITION BY doc_id ORDER BY number) AS passage FROM r WHERE again)
      GROUP BY doc_id, passage HAVING sum(len(w)) >= 40
    ), kept AS (
      SELECT doc_id, string_agg(piece, '' ORDER BY k) AS text FROM q
      WHERE NOT EXISTS (FROM c WHERE c.doc_id = q.doc_id AND q.start >= c.start AND q.start < c."end") GROUP BY doc_id
    ), told AS (
      SELECT doc_id, string_agg(CAST(start AS BIGINT) || ':' || CAST("end" AS BIGINT), ',' ORDER BY start) AS removed,
        count(*) AS n_removed FROM c GROUP BY doc_id
    )
    SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
      coalesce(removed, '') AS removed, coalesce(n_removed, 0) AS n_removed
    FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN told USING (doc_id)
    """
)
def op8_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier place already has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    span = F.transform("removed", lambda r: F.concat_ws(":", r["start"], r["end"]))
    return remove_passages(docs).select(
        "doc_id", "text", F.array_join(span, ",").alias("removed"), F.size("removed").cast("long").alias("n_removed")
    )
