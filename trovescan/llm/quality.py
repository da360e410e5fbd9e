"""Quality by the perplexity of an n-gram model of the words of trusted text (operator 1)."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trovescan.llm.registry import query, table
from trovescan.session import materialize

#: Of the trusted documents of a language, this share passes each of the tests (see ``TESTS``).
QUANTILE = 0.995
#: Every so-many-th trusted document (by the hash of its id) is not trained on; these set the thresholds.
CALIBRATION = 2
#: Perplexities are compared in steps of so many bits.
STEP = 0.001
#: What may not exceed its threshold; "-bits" is a lower bound on bits.
TESTS = ("bits", "-bits", "repetition")
#: Repetition is looked for in windows of so many words.
WINDOW = 16
#: Documents meet the model in blocks of about so many characters.
BLOCK_CHARS = 4_000_000
#: Model rows, or words to look up, that meet in one task.
PART_ROWS = 1_000_000
#: A task holds about so many model rows while it deals them out to the parts.
HELD_ROWS = 500_000
#: Words of a block whose costs are computed at once.
COST_WORDS = 65_536
#: Blocks are scored in up to so many rounds, one for each so many characters, and what is shuffled for a round goes with it.
ROUNDS, ROUND_CHARS = 3, 100_000_000
#: An unknown pair or word is taken for a known one at most once in 2 ** so many times.
SPARE_BITS = 20
#: Labelled ids are broadcast up to this many rows (of 8 bytes), and joined by shuffle beyond.
BROADCAST_ROWS = 2_000_000


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more, from the counts of counts."""
    if not n1 or not n2:  # too few n-grams to estimate them
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return tuple(min(max(x, 0.01), i + 0.99) for i, x in enumerate(d))


# Runs of letters and digits, single signs of scripts without blanks, runs of other signs.
_SOLID = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_SOLID}]|[^\W{_SOLID}]+|[^\w\s]+")
_FIRST = 1  # stands before the first word


def digest(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class Hashes(dict):
    """64-bit digests of words. One object belongs to one task and goes when that ends."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 250_000:
            self.clear()
        self[word] = out = digest(word)
        return out


def words_of(text: str | None, hashes: Hashes | None = None) -> np.ndarray:
    """The 64-bit digests of the words, in lower case, in order."""
    hashes = Hashes() if hashes is None else hashes
    return np.fromiter(map(hashes.__getitem__, _WORD.findall((text or "").lower())), np.int64)


def before_of(words: np.ndarray) -> np.ndarray:
    return np.concatenate([np.full(min(1, len(words)), _FIRST, np.int64), words[:-1]])


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    keys = before.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + words.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (keys ^ (keys >> np.uint64(29))).view(np.int64)


def repetition(words: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """How many bits the most repetitive window of each text's words lacks: log2 of its size over its words' perplexity.

    That is the perplexity (of order two) of the window's own words. 0 if no window repeats a word. ``words`` are those
    of all texts, one text behind the other, and ``counts`` says how many each has; a text of fewer words than a window is one.
    """
    n, starts = len(words), np.cumsum(counts) - counts
    least = np.zeros(len(counts))
    long, short = np.flatnonzero(counts >= window), np.flatnonzero((counts > 0) & (counts < window))
    whole = max(0, n - window + 1)
    of_window, of_text = np.zeros(n + 1, np.int64), np.zeros(len(short), np.int64)
    for lag in range(1, min(window, n)):
        upto = np.concatenate([[0], np.cumsum(words[lag:] == words[:-lag])])
        of_window[:whole] += upto[window - lag : window - lag + whole] - upto[:whole]
        inside = counts[short] > lag
        first = starts[short][inside]
        of_text[inside] += upto[first + counts[short][inside] - lag] - upto[first]
    if len(long):
        spans = np.stack([starts[long], starts[long] + counts[long] - window + 1], 1).ravel()
        least[long] = np.log2(1 + 2 * np.maximum.reduceat(of_window, spans)[::2] / window)
    least[short] = np.log2(1 + 2 * of_text / counts[short])
    return least


def _word_pairs(texts: DataFrame) -> DataFrame:
    """(v, w, c): how often word w follows v. Tasks count before the shuffle."""

    def counted(held):
        words, before = np.concatenate(held), np.concatenate([before_of(w) for w in held])
        _, at, c = np.unique(pair_keys(before, words), return_index=True, return_counts=True)
        for i in range(0, len(at), 100_000):
            s = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[s], pa.int64()) for x in (before[at], words[at], c)], names=["v", "w", "c"])

    def run(batches):
        held, size, hashes = [], 0, Hashes()
        for batch in batches:
            for text in batch.column(0):
                held.append(words_of(text.as_py(), hashes))
                size += len(held[-1])
                if size > 1_000_000:
                    yield from counted(held)
                    held, size = [], 0
        if held:
            yield from counted(held)

    return texts.mapInArrow(run, "v long, w long, c long").groupBy("v", "w").agg(F.sum("c").alias("c"))


#: What the model knows of a word.
_OF_WORD = ("total", "ones", "twos", "more", "preceded")
_MODEL = "part int, n int, key binary, c binary, " + ", ".join(f"{c} binary" for c in _OF_WORD)


@dataclass(frozen=True)
class Model:
    """An interpolated modified Kneser-Ney model of word pairs.

    ``rows`` has (v, w, c, total, ones, twos, more, preceded): for a pair of words its count c; for a word v, where c is 0,
    the count of the pairs that it begins, how many of them occur once, twice, and more often, and the number of different
    words before it. ``parts`` stores the same by keys, many to a row. Keys are the first ``bits``
    bits of digests, and a part has all keys with the same first bits, so it stays dealt out, and never is in one place.
    """

    rows: DataFrame
    parts: DataFrame
    constants: dict
    bits: int
    part_bits: int


def train_words(texts: DataFrame, chars: int = 0) -> Model:
    """Train on texts (one string column, no nulls). ``chars`` of text will be looked up, which sets the number of parts.

    The table has a row for each different pair and word of the texts, and grows with them.
    """
    pairs = materialize(_word_pairs(texts).sortWithinPartitions("v", "w"), "pairs", release=True)
    few = lambda c: [F.coalesce(F.sum((F.col(c) == i).cast("long")), F.lit(0)) for i in (1, 2, 3, 4)]
    n_pairs, *seen = pairs.agg(F.count(F.lit(1)), *few("c")).first()
    upper = discounts(*seen)
    zero = F.lit(0).cast("long")
    often = [F.count_if(x).alias(c) for c, x in zip(_OF_WORD[1:4], (F.col("c") == 1, F.col("c") == 2, F.col("c") > 2), strict=True)]
    begins = pairs.groupBy(F.col("v").alias("word")).agg(F.sum("c").alias("total"), *often).withColumn("preceded", zero)
    ends = pairs.groupBy(F.col("w").alias("word")).agg(*[zero.alias(c) for c in _OF_WORD[:4]], F.count(F.lit(1)).alias("preceded"))
    words = materialize(begins.unionByName(ends).groupBy("word").agg(*[F.sum(c).alias(c) for c in _OF_WORD]), "words", release=True)
    known = words.where("preceded > 0")
    n_words = words.count()
    size, total, *before = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("preceded"), zero), *few("preceded")).first()
    lower = discounts(*before)
    n = [known.where(f"preceded {x}").count() for x in ("= 1", "= 2", "> 2")]
    left = sum(a * b for a, b in zip(n, lower, strict=True)) / total if total else 1.0
    constants = {"upper": upper, "lower": lower, "total": total, "rest": left / (size + 1)}
    n_rows = n_pairs + n_words
    bits = min(63, SPARE_BITS + max(1, n_rows).bit_length())
    part_bits = min(bits, max(0, (max(n_rows, chars // 6) // PART_ROWS).bit_length()))

    own = pairs.select("v", "w", "c", *[zero.alias(c) for c in _OF_WORD])
    rows = own.unionByName(words.select(F.col("word").alias("v"), zero.alias("w"), zero.alias("c"), *_OF_WORD))
    starts = _starts(bits, part_bits)

    def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks(held):
            table = pa.Table.from_batches(held)
            v, w, c = (table.column(x).to_numpy() for x in ("v", "w", "c"))
            key = shortened(np.where(c > 0, pair_keys(v, w), v), bits)
            table = table.append_column("key", pa.array(key)).append_column("part", pa.array(key >> (bits - part_bits)))
            out = []
            for part, own in _cut_by(table.take(pa.array(np.argsort(key))), "part"):
                values = [squeezed(own.column(x).to_numpy()) for x in ("c", *_OF_WORD)]
                out.append((part, len(own), squeezed(np.diff(own.column("key").to_numpy(), prepend=starts[part])), *values))
            return _chunk(_MODEL, (pa.int32(), pa.int32(), *[pa.binary()] * 7), out).to_batches()

        return (x for held in _held(batches, lambda b: b.num_rows, HELD_ROWS) for x in chunks(held))

    return Model(rows, materialize(rows.mapInArrow(by_part, _MODEL), "model"), constants, bits, part_bits)


def _starts(bits: int, part_bits: int) -> np.ndarray:
    """The first key of each part, and one beyond all."""
    return np.arange((1 << part_bits) + 1) << (bits - part_bits)


def _held(batches: Iterator[pa.RecordBatch], size, most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches together, until they have the size."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += size(batch)
        if total > most:
            yield held
            held, total = [], 0
    if held:
        yield held


def shortened(digests: np.ndarray, bits: int) -> np.ndarray:
    return (digests.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, lowest first, without the planes that are all zero."""
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T
    used = np.flatnonzero(planes.any(axis=1))
    return planes[: used[-1] + 1 if len(used) else 0].tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.zeros((8, n), np.uint8)
    if data:
        planes[: len(data) // n] = np.frombuffer(data, np.uint8).reshape(-1, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


def _chunk(names: str, types: tuple, rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else ([] for _ in types)
    return pa.table({c.split()[0]: pa.array(x, t) for c, x, t in zip(names.split(", "), columns, types, strict=True)})


def squeezed(numbers: np.ndarray) -> bytes:
    """``packed``, with the planes compressed that this makes smaller: how many there are, their sizes, and they."""
    data, n, codec = packed(numbers), len(numbers), pa.Codec("zstd")
    planes = []
    for at in range(0, len(data), max(1, n)):
        small = codec.compress(data[at : at + n], asbytes=True)
        planes.append(small if len(small) < n else data[at : at + n])
    return bytes([len(planes)]) + np.array([len(x) for x in planes], "<u4").tobytes() + b"".join(planes) if planes else b""


def unsqueezed(data: bytes, n: int) -> np.ndarray:
    if not data:
        return unpacked(data, n)
    ends = 1 + 4 * data[0] + np.cumsum([0, *np.frombuffer(data, "<u4", data[0], 1).tolist()])
    planes = [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    return unpacked(b"".join(x if len(x) == n else pa.Codec("zstd").decompress(x, n, asbytes=True) for x in planes), n)


def _stored(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _cut_by(table: pa.Table, column: str) -> Iterator[tuple[int, pa.Table]]:
    """(value, its rows) for each value of a column, the rows in the table's order."""
    values = table.column(column).to_numpy()
    order = np.argsort(values, kind="stable")
    each, starts = np.unique(values[order], return_index=True)
    table = table.take(pa.array(order))
    for value, at, to in zip(each.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
        yield value, table.slice(at, to - at)


def word_costs(c: np.ndarray, total: np.ndarray, taken: np.ndarray, preceded: np.ndarray, constants: dict) -> np.ndarray:
    """Minus log2 of the probability of words after the ones before them: the pair's count, what the word before
    begins, and how many words precede the word."""

    def cut(c, d):
        return np.where(c > 2, d[2], np.where(c > 1, d[1], np.where(c > 0, d[0], 0.0)))

    p = (preceded - cut(preceded, constants["lower"])) / max(constants["total"], 1) + constants["rest"]
    some = np.maximum(total, 1)
    return -np.log2(np.where(total > 0, (c - cut(c, constants["upper"])) / some + taken / some * p, p))


def _nullable(kind: pa.DataType) -> pa.DataType:
    """The type with nulls allowed at every depth, as in a schema that is written down."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _nullable(f.type)) for f in kind])
    if pa.types.is_map(kind):
        return pa.map_(kind.key_type, _nullable(kind.item_type))
    return pa.list_(_nullable(kind.value_type)) if pa.types.is_list(kind) else kind


_BLOCK = "block long, docs binary, n_own int, own binary, places binary"
_REQUEST = "part int, block long, n_pairs int, n_words int, pairs binary, words binary"
_ANSWER = "block long, part int, n_pairs int, n_words int, c binary, " + ", ".join(f"{c} binary" for c in _OF_WORD)


def score_words(docs: DataFrame, model: Model, stored: bool = False) -> DataFrame:
    """Adds n_words, bits (mean cost of a word) and repetition; null without words. Needs columns id, salt and text.

    Documents of a salt, which lie together, are dealt to blocks of bounded size, and move once: as the different words of a
    block and the places of these in its texts.
    For each part of the model a block sends one row: its different
    pairs and words, as sorted numbers that are stored by their differences. The answer has their counts in the
    same order, so no key travels back. What is moved grows with the documents, and no model is gathered or broadcast.
    With ``stored``, the result is stored and has no texts; blocks take turns then, so that only some of them lie on the disks.
    """
    bits, part_bits, constants = model.bits, model.part_bits, model.constants
    # one row for each partition of the input
    sizes = docs.groupBy(F.col("salt").alias("of_salt")).agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    sizes = materialize(sizes, "sizes")
    cuts = (F.coalesce("chars", F.lit(0)) / BLOCK_CHARS).cast("long") + 1
    dealt = docs.join(F.broadcast(sizes), F.col("salt") == F.col("of_salt"), "left").withColumn("cuts", cuts)
    within = F.pmod(F.xxhash64("id", "text", "salt"), "cuts")
    block = (F.shiftleft(F.col("salt").cast("long"), 32) + within).alias("block")
    rest = [c for c in docs.columns if c not in ("text", "salt")]
    loose = dealt.select(block, F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"), "text")
    kind = loose.schema["rest"].dataType.simpleString()
    columns = ["rest"] if stored else ["rest", "text"]

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks(held):
            ids = defaultdict()
            ids.default_factory = ids.__len__
            digests = np.empty(0, np.int64)
            for block, own in _cut_by(pa.Table.from_batches(held), "block"):
                texts = [np.fromiter(map(ids.__getitem__, _WORD.findall((x.as_py() or "").lower())), np.int32) for x in own.column("text")]
                new = map(digest, islice(ids, len(digests), None))
                digests = np.concatenate([digests, np.fromiter(new, np.int64)])
                used, at, often = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
                # the most frequent words first, so that the places are mostly small numbers
                order = np.lexsort((digests[used].view(np.uint64), -often))
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                docs = own.select(columns).append_column("n", pa.array([len(x) for x in texts], pa.int64()))
                words = squeezed(np.diff(digests[used][order].view(np.uint64), prepend=np.uint64(0)))
                yield _chunk(_BLOCK, (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()),
                             [(block, _stored(docs.combine_chunks()), len(used), words, squeezed(place[at]))]).to_batches()[0]

        return (x for held in _held(batches, lambda b: b.column("text").nbytes, 2 * BLOCK_CHARS) for x in chunks(held))

    starts = _starts(bits, part_bits)

    def opened(chunks: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        """Texts, the words that each chunk of them has, which of these stands at each place, and how many places a text has."""
        docs = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in chunks.column("docs")]
        words, at, upto = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for own, row in zip(docs, chunks.select(["n_own", "own", "places"]).to_pylist(), strict=True):
            words.append(np.cumsum(unsqueezed(row["own"], row["n_own"])))
            at.append(unsqueezed(row["places"], sum(own.column("n").to_pylist())) + upto)
            upto += row["n_own"]
        texts = pa.concat_tables(docs)
        return texts, np.concatenate(words), np.concatenate(at), texts.column("n").to_numpy()

    def pairs_of(words: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The shortened pair that ends at each place."""
        run = words[at]
        before = np.concatenate([[_FIRST], run])[:-1].astype(np.int64)
        before[(np.cumsum(counts) - counts)[counts > 0]] = _FIRST
        return shortened(pair_keys(before, run), bits)

    def keys_of(words: np.ndarray) -> np.ndarray:
        """The shortened words, behind the one that starts a text."""
        return shortened(np.concatenate([[_FIRST], words]).astype(np.int64), bits)

    def asked(texts: pa.Table) -> pa.Table:
        _, words, at, counts = opened(texts)
        keys = [np.unique(pairs_of(words, at, counts)), np.unique(keys_of(words))]
        ends = [np.searchsorted(x, starts) for x in keys]
        block, rows = texts.column("block")[0].as_py(), []
        for part in range(1 << part_bits):
            own = [x[e[part] : e[part + 1]] for x, e in zip(keys, ends, strict=True)]
            if len(own[0]) or len(own[1]):
                rows.append((part, block, *map(len, own), *[squeezed(np.diff(x, prepend=starts[part])) for x in own]))
        return _chunk(_REQUEST, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), rows)

    def answered(requests: pa.Table, held: pa.Table) -> pa.Table:
        chunks = held.to_pylist()
        joined = lambda c: np.concatenate([np.empty(0, np.int64), *[unsqueezed(r[c], r["n"]) for r in chunks]])
        columns = {c: joined(c) for c in ("c", *_OF_WORD)}
        keys = np.concatenate([np.empty(0, np.int64), *[np.cumsum(unsqueezed(r["key"], r["n"])) + starts[r["part"]] for r in chunks]])
        is_pair = columns["c"] > 0
        known = []
        for of, values in ((is_pair, ("c",)), (~is_pair, _OF_WORD)):
            key, at = np.unique(keys[of], return_inverse=True)  # keys that share their bits are added up
            sums = [np.bincount(at, columns[c][of], len(key)) for c in values]
            known.append((key, [np.append(x, 0.0) for x in sums]))

        def look(which: int, first: int, data: bytes, n: int) -> list[bytes]:
            key, values = known[which]
            wanted = np.cumsum(unsqueezed(data, n)) + first
            at = np.searchsorted(key, wanted)
            at = np.where(np.append(key, -1)[at] == wanted, at, len(key))
            return [squeezed(v[at]) for v in values]

        rows = []
        for row in requests.select(["part", "block", "n_pairs", "n_words", "pairs", "words"]).to_pylist():
            first = starts[row["part"]]
            found = look(0, first, row["pairs"], row["n_pairs"]) + look(1, first, row["words"], row["n_words"])
            rows.append((row["block"], row["part"], row["n_pairs"], row["n_words"], *found))
        return _chunk(_ANSWER, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 6), rows)

    def told(chunks: pa.Table, answer: pa.Table) -> pa.Table:
        texts, words, at, counts = opened(chunks)
        rows = answer.sort_by("part").to_pylist()
        whole = lambda c, n: np.concatenate([np.empty(0, np.int64), *[unsqueezed(r[c], r[n]) for r in rows]])
        pair_at = np.unique(pairs_of(words, at, counts), return_inverse=True)[1].astype(np.int32)
        word_at = np.unique(keys_of(words), return_inverse=True)[1].astype(np.int32)
        ends = np.cumsum(counts)
        first = (ends - counts)[counts > 0]
        before_at = np.concatenate([word_at[:1], word_at[1:][at[:-1]]])[: len(at)]
        before_at[first] = word_at[0]
        c, total, preceded = whole("c", "n_pairs"), whole("total", "n_words"), whole("preceded", "n_words")
        taken = sum(d * whole(x, "n_words") for d, x in zip(constants["upper"], _OF_WORD[1:4], strict=True))
        costs, lacking = np.empty(len(at)), np.empty(len(counts))
        for start in range(0, len(at), COST_WORDS):
            s = slice(start, start + COST_WORDS)
            costs[s] = word_costs(
                c[pair_at[s]], total[before_at[s]], taken[before_at[s]], preceded[word_at[1:][at[s]]], constants
            )
        cuts = np.unique(np.searchsorted(ends, np.arange(0, len(at), COST_WORDS), "left"))  # some texts at a time
        for i, to in zip([0, *cuts[cuts > 0].tolist()], [*cuts[cuts > 0].tolist(), len(counts)], strict=True):
            lacking[i:to] = repetition(at[ends[i - 1] if i else 0 : ends[to - 1]], counts[i:to])
        mean = np.full(len(counts), np.nan)
        mean[counts > 0] = np.add.reduceat(costs, first) / counts[counts > 0] if len(at) else 0.0
        missing = counts == 0
        new = {
            "n_words": pa.array(counts), "bits": pa.array(mean, pa.float64(), mask=missing),
            "repetition": pa.array(lacking, pa.float64(), mask=missing),
        }
        rest = texts.column("rest")
        text = {} if stored else {"text": texts.column("text")}
        return pa.table({"rest": rest.cast(_nullable(rest.type)), **text, **new})

    def scored(loose: DataFrame) -> DataFrame:
        blocks = loose.mapInArrow(gathered, _BLOCK)
        requests = blocks.groupBy("block").applyInArrow(asked, _REQUEST)
        answers = requests.groupBy("part").cogroup(model.parts.groupBy("part")).applyInArrow(answered, _ANSWER)
        text = [] if stored else ["text"]
        new = ", ".join([f"rest {kind}", *[f"{c} string" for c in text], "n_words long, bits double, repetition double"])
        rows = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(told, new)
        return rows.select("rest.*", *text, "n_words", "bits", "repetition")

    if not stored:
        return scored(loose)
    rounds = min(ROUNDS, (sizes.agg(F.sum("chars")).first()[0] or 0) // ROUND_CHARS + 1)
    turn = F.pmod(F.xxhash64("block"), F.lit(rounds))
    return reduce(DataFrame.unionByName, [materialize(scored(loose.where(turn == i)), "scored", release=True) for i in range(rounds)])


def thresholds(scored: DataFrame, quantile: float, step: float = STEP) -> DataFrame:
    """(any, lang, bounds): for each of ``TESTS`` the quantile over a language's calibrating documents, or any language's.

    Documents are counted by steps of bits before anything is ordered, so a language with any number of
    documents is a few thousand rows. A language with too few for the quantile to differ from their
    largest takes that of all; if all are too few, the quantile lies beyond what they show and is taken
    as their largest and a standard deviation.
    """
    values = F.array(*[F.ceil(F.expr(t) / step) for t in TESTS])
    binned = scored.where("calibrates and bits is not null").select("lang", F.posexplode(values).alias("test", "bin")).where("bin is not null")
    both = binned.withColumn("group", F.explode(F.array_distinct(F.array(F.struct(F.lit(False).alias("any"), "lang"), F.struct(F.lit(True).alias("any"), F.lit(None).cast("string").alias("lang"))))))
    bins = both.groupBy("group", "test", "bin").agg(F.count(F.lit(1)).alias("c"))
    own = Window.partitionBy("group", "test")
    upto = F.sum("c").over(own.orderBy("bin"))
    mean, square = (F.sum(F.col("c") * F.pow("bin", F.lit(i))).over(own) / F.col("all") for i in (1.0, 2.0))
    enough = F.col("all") * (1 - F.lit(quantile)) >= 1
    found = (
        bins.withColumn("upto", upto).withColumn("all", F.sum("c").over(own))
        .withColumn("beyond", F.when(enough, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))))
        .where(F.col("group.any") | enough)
        .where(F.col("upto") >= F.lit(quantile) * F.col("all"))
        .groupBy("group", "test").agg(((F.min("bin") + F.max("beyond")) * step).alias("bound"))
    )
    bounds = F.array(*[F.max(F.when(F.col("test") == i, F.col("bound"))) for i in range(len(TESTS))])
    return found.groupBy("group").agg(bounds.alias("bounds")).select("group.any", "group.lang", "bounds")


def classify(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    quantile: float = QUANTILE,
    calibration: int = CALIBRATION,
) -> DataFrame:
    """Perplexity of every document under a model of the trusted ones, and whether it stays.

    ``docs`` is a stored table; ``trusted`` has the ids of trusted documents. All of their texts train the model, but for every
    ``calibration``-th, which stay unseen and set the thresholds (0: all do both). The model is of words
    and the words before them, with no fixed list of either; it is joined with the documents' own words by key.
    A document stays if it passes all ``TESTS``: its bits per word lie neither above nor below what its language
    allows, and no window of its words is more repetitive than the threshold. Each bound is the ``quantile``
    over calibrating documents; a language with too few of them takes that of all.

    Returns ``id_col``, lang, n_words, bits, perplexity, threshold (of bits), low (lower bound of bits),
    repetition, repetition_threshold, trusted, keep. A text without words (null, empty, blanks) has null bits
    and does not stay; a null language is one of its own; a null id is never trusted; repeated rows are
    scored alike; a text of any length is scored whole, in one block; without any trusted text nothing is
    rejected but texts without words; an empty table gives no rows; other columns are not read.
    """
    narrow = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), _salt()
    )
    marked, model = _trained(narrow, trusted.select(F.col(id_col).alias("trusted_id")), calibration)
    scored = score_words(marked, model, stored=True)
    bound = lambda i: F.element_at("bounds", i + 1)
    return _judged(scored, thresholds(scored, quantile)).select(
        F.col("id").alias(id_col), "lang", "n_words", "bits", F.pow(F.lit(2.0), "bits").alias("perplexity"), bound(0).alias("threshold"),
        (-bound(1)).alias("low"), "repetition", bound(2).alias("repetition_threshold"), "trusted", "keep",
    )


def keep_good(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    quantile: float = QUANTILE,
    calibration: int = CALIBRATION,
) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns. Null, empty, repeated and very long
    texts, and empty tables, are treated as it says; columns of any names pass through."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    wide = docs.select(row, F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), _salt())
    marked, model = _trained(wide.drop("row"), trusted.select(F.col(id_col).alias("trusted_id")), calibration)
    bounds = thresholds(score_words(marked.where("calibrates"), model, stored=True), quantile)
    # the text travels once, beside the row's other columns
    others = F.struct(*[F.col(f"row.`{c}`") for c in docs.columns if c != text_col]).alias("row")
    kept = _judged(score_words(wide.select("id", "lang", others, "text", "salt"), model), bounds).where("keep")
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])


def _salt():
    """The number of a row's partition of the input, which spreads rows that repeat. The input is read more than once
    and has to be a stored table, whose rows keep that number."""
    return F.spark_partition_id().alias("salt")


def _trained(narrow: DataFrame, trusted: DataFrame, calibration: int) -> tuple[DataFrame, Model]:
    """``narrow`` (id, lang, text) with columns "trusted" and "calibrates", and a model of its trusted texts."""
    ids = trusted.where("trusted_id is not null").distinct()
    ids = materialize(ids.withColumn("trusted", F.lit(True)), "trusted")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    trusted = F.coalesce("trusted", F.lit(False))
    held_out = F.pmod(F.xxhash64("id"), F.lit(calibration)) == 0 if calibration else F.lit(True)
    marked = narrow.join(ids, F.col("id") == F.col("trusted_id"), "left").select(
        "id", "lang", trusted.alias("trusted"), (trusted & held_out).alias("calibrates"), "text", "salt"
    )
    learnt = marked.where("trusted and not calibrates") if calibration else marked.where("trusted")
    chars = narrow.agg(F.sum(F.length("text"))).first()[0] or 0
    return marked, train_words(learnt.where("length(text) > 0").select("text"), chars)


def _judged(scored: DataFrame, bounds: DataFrame) -> DataFrame:
    """Adds the bounds and whether a document stays. Bounds are one row per language."""
    bounds = materialize(bounds, "thresholds")
    own = bounds.where("not any").select(F.col("lang").alias("_lang"), F.col("bounds").alias("own"))
    everyone = bounds.where("any").agg(F.first("bounds").alias("everyone"))
    passed = [(F.expr(t) <= F.element_at("bounds", i + 1)) for i, t in enumerate(TESTS)]
    return (
        scored.join(own, F.col("lang").eqNullSafe(F.col("_lang")), "left")
        .join(F.broadcast(everyone), F.lit(True), "left")
        .withColumn("bounds", F.transform(F.sequence(F.lit(1), F.lit(len(TESTS))), lambda i: F.coalesce(F.element_at("own", i), F.element_at("everyone", i))))
        .withColumn("keep", F.col("bits").isNotNull() & ~F.exists(F.array(*passed), lambda p: F.coalesce(~p, F.lit(False))))
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled as good and not toxic."""
    return labels.where("quality = 1 and toxic = 0").select("doc_id")


@query()
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity, its language's threshold and whether it stays."""
    return classify(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))
