"""Benchmark passages in training documents, found by winnowed fingerprints (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovescan.llm.byte_words import WordDigests, runs
from trovescan.llm.registry import query, table
from trovescan.session import materialize

WINDOW = 10
GRAM = 5
#: Benchmark fingerprints, windows and item sets are sent to every task up to so many rows (8 to 24 bytes each).
MAX_BROADCAST = 2_000_000

_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _combined(columns: list[np.ndarray], seed: int) -> np.ndarray:
    """One 64-bit hash for each row of consecutive word digests."""
    x = np.full(len(columns[0]), seed, np.uint64)
    for column in columns:
        x = (x ^ column) * _ODD
        x ^= x >> np.uint64(29)
    x *= _MIX
    x ^= x >> np.uint64(32)
    return np.where(x == _NONE, np.uint64(0), x)


def gram_hashes(digests: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    m = len(digests) - n + 1
    return _combined([digests[i : i + m] for i in range(n)], 1) if m > 0 else np.empty(0, np.uint64)


def window_hashes(digests: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows of ``length`` words that start at ``starts``."""
    return _combined([digests[starts + i] for i in range(length)], 2)


def chosen(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` consecutive hashes, the place of its smallest one, the last of equal ones."""
    if len(hashes) < width:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, width)
    return np.arange(len(views)) + width - 1 - views[:, ::-1].argmin(axis=1)


@dataclass(frozen=True)
class Sizes:
    """Windows of ``length`` words, of which winnowing keeps one run of ``gram`` words each."""

    length: int
    gram: int

    @property
    def width(self) -> int:
        return self.length - self.gram + 1


def _sizes(length: int, gram: int) -> Sizes:
    return Sizes(length, min(gram, length))


class _Run:
    """The words of several documents behind each other, and which belong to which."""

    def __init__(self, texts: list[bytes | None], digests: WordDigests):
        parts = [digests.of(text) for text in texts]
        self.counts = np.array([len(p) for p in parts], np.int64)
        self.ends = np.cumsum(self.counts)
        self.begins = self.ends - self.counts
        self.words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        self.owner = np.repeat(np.arange(len(parts)), self.counts)

    def prints(self, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the fingerprints: every window within a document has at least one."""
        hashes = gram_hashes(self.words, sizes.gram)
        hashes[self.owner[: len(hashes)] != self.owner[sizes.gram - 1 :][: len(hashes)]] = _NONE
        places = np.unique(chosen(hashes, sizes.width))
        places = places[hashes[places] != _NONE]
        return places, hashes[places]

    def around(self, places: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of all windows that hold a fingerprint at one of ``places``, within its document."""
        starts = np.unique((places[:, None] - np.arange(sizes.width)).ravel())
        starts = starts[starts >= 0]
        owner = self.owner[starts]
        starts = starts[starts + sizes.length <= self.ends[owner]]
        return starts, window_hashes(self.words, starts, sizes.length)

    def marked(self, hits: list[tuple[np.ndarray, int]]) -> tuple[pa.Array, pa.Array]:
        """The hit words of each document: their number, and their maximal stretches."""
        change = np.zeros(len(self.words) + 1, np.int64)
        for starts, length in hits:
            np.add.at(change, starts, 1)
            np.add.at(change, starts + length, -1)
        hit = np.cumsum(change)[:-1] > 0
        before = np.concatenate([[0], np.cumsum(hit)])
        first = hit & ~np.concatenate([[False], hit[:-1] & (self.owner[1:] == self.owner[:-1])]) if len(hit) else hit
        last = hit & ~np.concatenate([hit[1:] & (self.owner[1:] == self.owner[:-1]), [False]]) if len(hit) else hit
        at, to = np.flatnonzero(first), np.flatnonzero(last) + 1
        own = self.owner[at]
        bounds = np.searchsorted(own, np.arange(len(self.counts) + 1)).astype(np.int32)
        inner = pa.StructArray.from_arrays(
            [pa.array(at - self.begins[own], pa.int64()), pa.array(to - self.begins[own], pa.int64())], ["start", "end"]
        )
        return pa.array(before[self.ends] - before[self.begins], pa.int64()), pa.ListArray.from_arrays(bounds, inner)


def _listed(owner: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """For each of n documents, its distinct values in order."""
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    owner, values = owner[new], values[new]
    bounds = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(bounds, pa.array(values, pa.int64()))


def _found(sorted_values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are among the sorted values, and where."""
    if not len(sorted_values):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return sorted_values[at] == wanted, at


@dataclass
class Fingerprints:
    """What is known of a benchmark: ``windows`` (length, window, item_set), ``prints`` (length, print),
    ``items`` (item_set, item). Windows of the same items have one item set."""

    lengths: list[Sizes]
    windows: DataFrame
    prints: DataFrame
    items: DataFrame


def fingerprint(
    benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM
) -> Fingerprints:
    """All windows of a benchmark, the fingerprint that winnowing keeps of each, and the items they come from.

    An item of fewer words than a window is one window of its own length; one without words, or a null text,
    has none. An item with a null id has windows but is not listed. Repeated rows change nothing.
    """
    if not 1 <= gram <= window:
        raise ValueError("1 <= gram <= window")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = WordDigests()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = digests.of(text)
                if not len(words):
                    continue
                sizes = _sizes(min(window, len(words)), gram)
                hashes = gram_hashes(words, sizes.gram)
                prints = hashes[chosen(hashes, sizes.width)]
                own = window_hashes(words, np.arange(len(prints)), sizes.length)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([item] * len(own), pa.string()), pa.array(np.full(len(own), sizes.length, np.int32)),
                        pa.array(own.view(np.int64)), pa.array(prints.view(np.int64)),
                    ],
                    names=["item", "length", "window", "print"],
                )

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    rows = items.mapInArrow(split, "item string, length int, window long, print long").distinct()
    rows = materialize(rows, "benchmark-windows")
    # An item set is known by its size and two hashes of its members, so no window gathers its items.
    sets = rows.groupBy("length", "window").agg(
        F.count("item").alias("n"), F.bit_xor(F.xxhash64("item")).alias("x"),
        F.bit_xor(F.xxhash64("item", F.lit(1))).alias("y"),
    )
    windows = sets.select("length", "window", F.xxhash64("n", "x", "y").alias("item_set"))
    windows = materialize(windows, "benchmark-sets")
    shown = windows.groupBy("item_set").agg(F.min(F.struct("length", "window")).alias("at")).select("item_set", "at.*")
    listed = rows.where("item is not null").join(shown, ["length", "window"]).select("item_set", "item").distinct()
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most ``window`` rows
    return Fingerprints(
        [_sizes(n, gram) for n in lengths], windows, rows.select("length", "print").distinct(),
        materialize(listed, "benchmark-items"),
    )


_FOUND = "n_words long, n_hit long, spans array<struct<start:bigint,end:bigint>>, item_sets array<bigint>"
_ADDED = ["n_words", "n_hit", "spans", "item_sets"]


def decontaminate(
    docs: DataFrame,
    known: Fingerprints,
    text_col: str = "text",
    keep: list[str] | None = None,
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """Find every window of the benchmark in every document, and mark the words it covers.

    Of each window of consecutive words winnowing keeps the smallest hash of a run of ``gram`` words, on both
    sides alike, so every shared window shares a fingerprint. Where fingerprints meet, the hit is extended to all
    windows around it, which are looked up whole.

    If the benchmark has at most ``max_broadcast`` fingerprints and windows, its sorted hashes go to every task and
    the documents are read once, without a shuffle. Beyond that, fingerprints and windows are joined by shuffle.

    Returns the columns ``keep`` (all, by default) of every row, and n_words; n_hit: words within a window's
    occurrence; spans: their maximal stretches (start, end), counted in words, end exclusive; item_sets: the
    item sets of the windows found, distinct and in order. A null or empty text has no words and no hits;
    rows that repeat are each marked; a text of any length is read whole, by pieces; an empty table gives no
    rows; a column named like one of the four gives way to it.
    """
    columns = [c for c in (docs.columns if keep is None else keep) if c not in _ADDED]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    n_windows, n_prints = known.windows.count(), known.prints.count()
    if n_windows + n_prints <= max_broadcast:
        found = _by_broadcast(rows, known)
    else:
        found = _by_join(rows, known)
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], *_ADDED)


def _arrays(known: Fingerprints) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By window length: sorted fingerprints, sorted windows, and their item sets. Called below a checked size only."""
    prints, windows = known.prints.toArrow(), known.windows.toArrow()
    out = {}
    for sizes in known.lengths:
        p = prints.filter(pc.equal(prints["length"], sizes.length))["print"].to_numpy().view(np.uint64)
        w = windows.filter(pc.equal(windows["length"], sizes.length))
        hashes, sets = w["window"].to_numpy().view(np.uint64), w["item_set"].to_numpy()
        order = np.argsort(hashes)
        out[sizes.length] = np.sort(p), hashes[order], sets[order]
    return out


def _by_broadcast(rows: DataFrame, known: Fingerprints) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(_arrays(known))
    lengths = known.lengths

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = WordDigests()
        for batch in batches:
            texts = batch.column("text")
            for begin, end in runs(texts):
                run = _Run(texts[begin:end].to_pylist(), digests)
                hits, owners, sets = [], [], []
                for sizes in lengths:
                    prints, windows, item_sets = held.value[sizes.length]
                    places, hashes = run.prints(sizes)
                    starts, hashes = run.around(places[_found(prints, hashes)[0]], sizes)
                    real, at = _found(windows, hashes)
                    hits.append((starts[real], sizes.length))
                    owners.append(run.owner[starts[real]])
                    sets.append(item_sets[at[real]] if len(item_sets) else at[real])
                n_hit, spans = run.marked(hits)
                listed = _listed(np.concatenate([[], *owners]).astype(np.int64), np.concatenate([np.empty(0, np.int64), *sets]), end - begin)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row")[begin:end], pa.array(run.counts), n_hit, spans, listed], names=["row", *_ADDED]
                )

    return rows.mapInArrow(mark, f"row {rows.schema['row'].dataType.simpleString()}, {_FOUND}")


def _by_join(rows: DataFrame, known: Fingerprints) -> DataFrame:
    """The same by shuffle. Places are kept by the digest of their text, so that copies are looked up once."""
    lengths = known.lengths
    texts = rows.select(F.md5(F.coalesce("text", F.lit(b""))).alias("digest"), "row", "text")

    def places_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = WordDigests()
        for batch in batches:
            for begin, end in runs(batch.column("text")):
                run = _Run(batch.column("text")[begin:end].to_pylist(), digests)
                for sizes in lengths:
                    places, hashes = run.prints(sizes)
                    yield _rows(batch, begin, run, sizes, places, hashes, "place", "print")

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = WordDigests()
        for batch in batches:
            for i in range(batch.num_rows):
                run, hits = _Run([batch.column("text")[i].as_py()], digests), batch.column("hits")[i].as_py()
                for sizes in lengths:
                    places = np.array([h["at"] for h in hits if h["length"] == sizes.length], np.int64)
                    starts, hashes = run.around(places, sizes)
                    yield _rows(batch, i, run, sizes, starts, hashes, "start", "window")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = WordDigests()
        for batch in batches:
            for i in range(batch.num_rows):
                run, hits = _Run([batch.column("text")[i].as_py()], digests), batch.column("hits")[i].as_py() or []
                by_length = [
                    (np.array([h["at"] for h in hits if h["length"] == s.length], np.int64), s.length) for s in lengths
                ]
                n_hit, spans = run.marked(by_length)
                sets = np.array([h["item_set"] for h in hits], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row")[i : i + 1], pa.array(run.counts), n_hit, spans, _listed(np.zeros(len(sets), np.int64), sets, 1)],
                    names=["row", *_ADDED],
                )

    prints = texts.select("digest", "text").mapInArrow(places_of, "digest string, length int, place long, print long")
    met = prints.join(known.prints, ["length", "print"], "left_semi").groupBy("digest").agg(
        F.collect_set(F.struct("length", F.col("place").alias("at"))).alias("hits")  # places within one text
    )
    one = texts.select("digest", "text").join(met, "digest").dropDuplicates(["digest"])
    windows = one.mapInArrow(windows_of, "digest string, length int, start long, window long")
    hits = windows.join(known.windows, ["length", "window"]).groupBy("digest").agg(
        F.collect_set(F.struct("length", F.col("start").alias("at"), "item_set")).alias("hits")
    )
    hits = materialize(hits, "benchmark-hits")
    return texts.join(hits, "digest", "left").select("row", "text", "hits").mapInArrow(
        mark, f"row {rows.schema['row'].dataType.simpleString()}, {_FOUND}"
    )


def _rows(batch, begin, run, sizes, places, hashes, at, hashed) -> pa.RecordBatch:
    own = run.owner[places]
    return pa.RecordBatch.from_arrays(
        [
            batch.column("digest").take(pa.array(own + begin)), pa.array(np.full(len(own), sizes.length, np.int32)),
            pa.array(places - run.begins[own], pa.int64()), pa.array(hashes.view(np.int64), pa.int64()),
        ],
        names=["digest", "length", at, hashed],
    )


def with_items(marked: DataFrame, known: Fingerprints, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Each marked row with items: the ids, as sorted strings, of the items with a window in it.

    Rows with the same item sets get the same list, which is made once. The rows are read twice, so they should be
    stored. ``item_sets`` gives way to ``items``, and so does a column of that name.
    """
    marked = marked.drop("items", "_profile")
    profile = F.md5(F.array_join(F.col("item_sets").cast("array<string>"), ","))
    hit = marked.where(F.size("item_sets") > 0).withColumn("_profile", profile)
    profiles = hit.select("_profile", "item_sets").dropDuplicates(["_profile"])
    sets = profiles.select("_profile", F.explode("item_sets").alias("item_set"))
    listed = (
        sets.join(known.items, "item_set").select("_profile", "item").distinct()
        .groupBy("_profile").agg(F.array_sort(F.collect_list("item")).alias("items"))  # one row's own result
    )
    listed = materialize(listed, "item-lists")
    small = listed.select(F.sum(F.size("items") + 1)).first()[0] or 0
    listed = F.broadcast(listed) if small <= max_broadcast else listed
    none = F.array().cast("array<string>")
    rest = [c for c in marked.columns if c != "item_sets"]
    full = hit.join(listed, "_profile", "left").select(*rest, F.coalesce("items", none).alias("items"))
    return full.unionByName(marked.where(F.size("item_sets") == 0).select(*rest, none.alias("items")))


@query(
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents
    ), b AS (
      SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark
    ), bw AS (
      SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
      FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
            FROM b WHERE len(w) > 0)
    ), dw AS (
      SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
    ), hits AS (
      SELECT r, i, n, item_id FROM dw JOIN bw USING (n, win)
    ), marks AS (
      SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
    ), items AS (
      SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN marks USING (r) LEFT JOIN items USING (r)
    """
)
def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the share of it that a benchmark has, and the items it comes from."""
    known = fingerprint(table(spark, sf_dir, "benchmark"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = materialize(decontaminate(docs, known, keep=["doc_id"]), "marked")
    return with_items(marked, known).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
