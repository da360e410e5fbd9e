"""Jaccard join on word shingles by token-combination prefixes (operator 10)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovescan.llm.components import components
from trovescan.llm.registry import query, table
from trovescan.llm.shingles import Digests, shingle_set
from trovescan.session import materialize

#: Shingles in the prefixes of more sets than this are frequent.
FREQUENT = 8
#: 64-bit numbers of the coarse parity sketch that joins compare; the fine one grows with the set.
SKETCH = 8
#: Sets of a frequent signature are dealt into blocks of about this many, which meet pair by pair.
BLOCK = 1024
#: A task holds the sets of so many texts at once.
SET_ROWS = 256
#: A list of ids is broadcast up to this many rows (of 8 bytes), and joined by shuffle beyond.
BROADCAST_ROWS = 2_000_000


def _classes(n: int) -> int:
    """Frequent shingles of sets of a size band (n to below 2n, n a power of two) fall into so many classes."""
    return max(1, 1 << (n.bit_length() - 6)) if n >= 32 else 1


def prefix_length(n: int, percent: int) -> int:
    """So many smallest shingles of a set of n are indexed.

    A set may miss n - ceil(percent% of n) of its shingles in a partner. One more must be shared, and
    each class of frequent shingles may hold one shared shingle without a shared pair.
    """
    return min(n, n - -(-percent * n // 100) + 1 + _classes(n))


def node_of(s: np.ndarray) -> int | None:
    """The digest that stands for a set of shingles; none for the empty set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None


def _fine(s: np.ndarray) -> np.ndarray:
    """Parities of the shingles by 2 bits or more a shingle: two differ in no more bits than their sets do in shingles."""
    size = 1 << max((64 * SKETCH - 1).bit_length(), (2 * len(s)).bit_length())
    bits = np.bincount((s >> np.uint64(20)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(bits.astype(np.uint8))


def _fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """The same parities by fewer bits (``size`` bytes)."""
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def _sets_of(batches: Iterator[pa.RecordBatch], size: int, columns: dict) -> Iterator[pa.RecordBatch]:
    """The batches with numbers of the texts' shingle sets in place of the texts, in pieces of ``SET_ROWS`` rows."""
    digests = Digests()
    for batch in batches:
        kept = [n for n in batch.schema.names if n != "text"]
        for at in range(0, batch.num_rows, SET_ROWS):
            rows = batch.slice(at, SET_ROWS)
            sets = [shingle_set(text.as_py(), size, digests) for text in rows.column("text")]
            made = [pa.array([f(s) for s in sets], kind) for _, kind, f in columns.values()]
            yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in kept], *made], names=[*kept, *columns])


def _with_sets(docs: DataFrame, size: int, columns: dict) -> DataFrame:
    """Replace the text of ``docs`` by numbers of its shingle set. columns: name -> (type, Arrow type, function)."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    kinds = ", ".join([*kept, *[f"{n} {kind}" for n, (kind, _, _) in columns.items()]])
    return docs.mapInArrow(lambda batches: _sets_of(batches, size, columns), kinds)


def _near(a: str, b: str, percent: int) -> Column:
    """Whether two sketched sets may be similar enough: by their sizes, and by the bits that differ."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH)), F.lit(0))
    return (
        (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent)
        & (differ * (100 + percent) <= (n_a + n_b) * (100 - percent))
    )


def _frequent_signatures(shared: DataFrame, percent: int) -> DataFrame:
    """(sig, node): pairs of frequent shingles of one class, for each size band that a set serves."""
    band = lambda n: F.length(F.bin(n)) - 1
    lower = F.floor((F.col("n") * percent + 99) / 100).cast("long")  # the smallest partner
    banded = shared.withColumn("band", F.explode(F.array_distinct(F.array(band(F.col("n")), band(lower)))))
    mask = F.expr("shiftleft(1L, greatest(0, band - 5)) - 1")
    groups = (
        banded.withColumn("class", F.col("shingle").bitwiseAND(mask))
        .groupBy("node", "band", "class")
        .agg(F.array_sort(F.collect_list("shingle")).alias("own"))
        .where(F.size("own") > 1)
    )
    pairs = F.flatten(
        F.transform("own", lambda x, i: F.transform(F.slice("own", i + 2, F.size("own")), lambda y: F.xxhash64("band", x, y)))
    )
    return groups.select(F.explode(pairs).alias("sig"), "node")


def _admitted(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose fine sketches do not differ too much; these are a small part of the sets' size."""

    def run(batches):
        for batch in batches:
            kept = []
            for n, x, y in zip(batch.column("n").to_pylist(), batch.column("fa"), batch.column("fb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                size = min(len(x), len(y))
                differ = int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum())
                kept.append(differ * (100 + percent) <= n * (100 - percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("fine").alias("fa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("fine").alias("fb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "fa", "fb")
    return materialize(both.mapInArrow(run, "a long, b long"), "admitted")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough, by their whole sets, built anew from one text of each set."""
    pairs = _admitted(pairs, nodes, percent)
    wanted = materialize(
        pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "version"), "node"), "wanted"
    )
    narrow = wanted.select("version").distinct()
    if wanted.count() <= BROADCAST_ROWS:
        narrow = F.broadcast(narrow)
    sets = (
        _with_sets(
            docs.join(narrow, "version", "left_semi").select("text"),
            size,
            {"node": ("long", pa.int64(), node_of), "s": ("binary", pa.binary(), lambda s: s.tobytes())},
        )
        .where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(F.first("s").alias("s"))
    )

    def run(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    return materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), "links")


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 3,
    percent: int = 90,
    frequent: int = FREQUENT,
) -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    A set holds the distinct shingles of ``size`` words (A-Z in lower case, between blanks), as 64-bit
    digests; equal sets are one node. Shingles are ordered by digest. Of every set a prefix is indexed:
    one more than may be missing in a partner, and one for each class of frequent shingles. Two similar
    sets then share a rare shingle of their prefixes, or two frequent shingles of one class; classes
    grow with a set's size, and a set serves the size bands of all its partners. So rare shingles are
    signatures alone (of at most ``frequent`` sets), frequent ones only in pairs. Candidates must pass
    bounds on size and on two parity sketches, and are verified on whole sets.

    No group's pairs are all written down: the sets of a frequent signature first meet two of
    them; what is linked by then is one component, and only sets of different components meet, in
    blocks, inside a join that lets pass what the sketch admits.

    Returns ``id_col``, n_shingles, component_id (smallest id reachable by links, its own included) and
    node (the set's digest). Fewer words than ``size`` form one shingle; null texts and those without
    words have 0 shingles, no node and their own id; a null id is never the smallest of its component
    unless alone; each row is a document, repeated rows are linked by their equal sets; an empty table
    gives no rows; other columns are not read. 64-bit digests may collide: with 10 ** 9 sets, at odds of
    about 1 in 40.
    """
    texts = docs.select(F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    columns = {
        "node": ("long", pa.int64(), node_of),
        "n": ("long", pa.int64(), len),
        "prefix": ("array<long>", pa.list_(pa.int64()), lambda s: s[: prefix_length(len(s), percent)].view(np.int64) if len(s) else []),
        "fine": ("binary", pa.binary(), lambda s: _fine(s).tobytes()),
        "sketch": ("array<long>", pa.list_(pa.int64()), lambda s: _fold(_fine(s), 8 * SKETCH).view(np.int64)),
    }
    per_set = _with_sets(texts, size, columns).where(F.col("node").isNotNull()).groupBy("node")
    nodes = materialize(
        per_set.agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("fine").alias("fine"), F.first("sketch").alias("sketch"), F.min("version").alias("version")),
        "nodes",
    )
    sketched = nodes.select("node", "n", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)])

    rows = nodes.select("node", "n", F.explode("prefix").alias("shingle"))
    counts = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    shared = materialize(rows.join(counts, "shingle"), "shared")

    # rare: the few sets of a shingle meet each other
    rare = shared.where(F.col("sets") <= frequent)
    x, y = rare.alias("x"), rare.alias("y")
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.node") < F.col("y.node")))
    met = met.where(F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent)
    met = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    close = (
        met.join(sketched.alias("p"), F.col("a") == F.col("p.node"))
        .join(sketched.alias("q"), F.col("b") == F.col("q.node"))
        .where(_near("p", "q", percent))
        .select("a", "b")
    )

    # frequent: the sets of a signature meet the smallest and the largest of it
    signed = materialize(
        _frequent_signatures(shared.where(F.col("sets") > frequent).select("node", "n", "shingle"), percent), "signed"
    )
    centres = signed.groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    star = (
        signed.join(centres, "sig").select(F.explode(F.array("low", "high")).alias("centre"), "node").where("centre <> node")
        .select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()
        .join(sketched.alias("p"), F.col("a") == F.col("p.node"))
        .join(sketched.alias("q"), F.col("b") == F.col("q.node"))
        .where(_near("p", "q", percent))
        .select("a", "b")
    )
    links = _verified(materialize(close.union(star).distinct(), "pairs"), nodes, texts, size, percent)
    found = materialize(components(links), "components")

    # then those that are not connected yet
    open_sets = (
        signed.join(centres.select("sig", "sets"), "sig")
        .join(sketched, "node")
        .join(found, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    several = open_sets.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    blocks = F.ceil(F.col("sets") / BLOCK).cast("int")
    dealt = (
        open_sets.join(several.select("sig"), "sig", "left_semi")
        .withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("blocks", blocks)
    )
    # each pair of blocks meets once: the lower block on the left, the higher on the right
    one = dealt.withColumn("other", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)))
    two = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("block"))))
    p, q = one.alias("p"), two.alias("q")
    rest = (
        p.join(
            q,
            (F.col("p.sig") == F.col("q.sig"))
            & (F.col("p.block") == F.col("q.other"))
            & (F.col("p.other") == F.col("q.block"))
            & ((F.col("p.block") < F.col("q.block")) | (F.col("p.node") < F.col("q.node")))
            & (F.col("p.component") != F.col("q.component"))
            & _near("p", "q", percent),
        )
        .select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b"))
        .distinct()
    )
    more = _verified(materialize(rest, "pairs"), nodes, texts, size, percent)
    joined = components(
        more.join(found.toDF("a", "ca"), "a", "left").join(found.toDF("b", "cb"), "b", "left")
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    ).toDF("component", "top")
    tops = found.join(joined, "component", "full").select(F.coalesce("node", "component").alias("node"), F.coalesce("top", "component").alias("top"))
    linked = materialize(tops.distinct(), "linked")

    # from sets back to documents
    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    numbered = materialize(
        _with_sets(ids, size, {"node": ("long", pa.int64(), node_of), "n": ("long", pa.int64(), len)}).join(linked, "node", "left")
        .withColumn("top", F.coalesce("top", "node")),
        "numbered",
    )
    lowest = numbered.where(F.col("top").isNotNull()).groupBy("top").agg(F.min("id").alias("low"))
    return numbered.join(lowest, "top", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("top").isNull(), F.col("id")).otherwise(F.col("low")).alias("component_id"),
        "node",
    )


@query(
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents
    ), s AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS sh FROM w
    ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    l AS (
      SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b USING (sh) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      WHERE a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))
    ), r AS (
      SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
    ), c AS (SELECT x, min(y) AS low FROM r GROUP BY x)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.low AS component_id
    FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.x = d.doc_id
    """
)
def op10_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component under a Jaccard similarity of 0.9 on three-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
