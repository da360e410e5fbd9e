"""Alignment of two tokenizers over the same texts, by merge-path pieces (operator 13)."""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trovescan.llm.byte_words import runs
from trovescan.llm.registry import query, table
from trovescan.session import materialize, scratch_path

#: Token ends (of both sides) in a piece.
PIECE = 65_536
#: The counts of at most so many id pairs, the most common ones, are sent to every task; other pairs are joined.
COMMON = 1_000_000
#: Pair counts that a task gathers before it adds them up, and passes them on if they are still many.
_GATHERED = 1_000_000
#: Bytes of text, or ids, that are worked on at a time, and documents.
_AT_ONCE, _DOCS_AT_ONCE = 1 << 20, 4096


class ByteLevel:
    """Ids and token bytes of a byte-level vocabulary.

    Texts of the characters in ``_PLAIN`` take the same merges from ``ranks``, which is faster; all others go
    through ``tokenizers`` itself. tests/llm compare both.
    """

    _OTHER = re.compile("[^\t\n\r -~¡-ſА-яぁ-んァ-ン一-龥가-힣]")

    def __init__(self, path: str, ranks: str | None):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings inside texts are ordinary text
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes shown as themselves
        rest = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in piece)
        self.merges = None
        if ranks:
            with open(ranks, "rb") as file:
                known = {base64.b64decode(token): int(i) for token, i in map(bytes.split, file)}
            self.merges = tiktoken.Encoding(
                "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={}
            )

    def __call__(self, texts: list[str]) -> list[list[int]]:
        texts = [" " + text for text in texts]
        if self.merges is None:
            return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
        return [
            self.library.encode(text, add_special_tokens=False).ids if self._OTHER.search(text)
            else self.merges.encode_ordinary(text)
            for text in texts
        ]


class Pieces:
    """Ids and token bytes of a sentencepiece vocabulary with byte fallback."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = [
            bytes([int(piece[3:5], 16)]) if self.library.is_byte(i)
            else b"" if self.library.is_control(i)
            else piece.replace("▁", " ").encode()
            for i in range(self.library.get_piece_size())
            for piece in [self.library.id_to_piece(i)]
        ]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


@functools.cache
def byte_level(path: str, ranks: str | None) -> ByteLevel:
    """One encoder for each Python worker and file."""
    return ByteLevel(path, ranks)


@functools.cache
def pieces_model(path: str) -> Pieces:
    return Pieces(path)


def default_left() -> ByteLevel:
    return byte_level(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def default_right() -> Pieces:
    return pieces_model(public_tokenizers.path("piece_bpe_32k.model"))


def split_point(a: np.ndarray, b: np.ndarray, diagonal: int) -> tuple[int, int]:
    """How many of the first ``diagonal`` values of the merge of two sorted lists come from each, by binary search.

    Of equal values the one in ``a`` comes first. A value of ``b`` that equals the last one taken from ``a`` is taken
    too, so that equal values are never parted.
    """
    lo, hi = max(0, diagonal - len(b)), min(diagonal, len(a))
    while lo < hi:
        mid = (lo + hi) // 2
        if a[mid] <= b[diagonal - mid - 1]:
            lo = mid + 1
        else:
            hi = mid
    i, j = lo, diagonal - lo
    if i and j < len(b) and a[i - 1] == b[j]:
        j += 1
    return i, j


class Merge:
    """The merged token ends of both sides over one stretch of bytes, which begins where both sides' ends are counted from.

    Between two ends lies exactly one token of each side, and two tokens that overlap share exactly one such stretch,
    so every end is one link. ``at_a`` and ``at_b`` are the linked tokens' places; a place may be one beyond the ends
    given, of the token that goes on in the next piece.
    """

    def __init__(self, a_ends: np.ndarray, b_ends: np.ndarray):
        base = int(min(a_ends[:1].tolist() + b_ends[:1].tolist(), default=1)) - 1
        top = int(max(a_ends[-1:].tolist() + b_ends[-1:].tolist(), default=base))
        seen = np.zeros(top - base + 1, np.uint8)
        seen[a_ends - base] = 1
        seen[b_ends - base] |= 2
        places = np.flatnonzero(seen)
        kinds = seen[places]
        self.ends = places + base
        in_a, in_b = (kinds & 1).astype(np.int64), (kinds >> 1).astype(np.int64)
        up_to_a, up_to_b = np.cumsum(in_a), np.cumsum(in_b)
        self.at_a, self.at_b = up_to_a - in_a, up_to_b - in_b
        common = kinds == 3
        #: Tokens of each side up to every place where both end.
        self.cut_a, self.cut_b = up_to_a[common], up_to_b[common]
        self.cut_ends = self.ends[common]


class Shown:
    """Writes groups as ``a1,a2|b1;a3|b2``."""

    def __init__(self, n_a: int, n_b: int):
        self.n_a, self.n_b = n_a, n_b
        self.table = [f"{i}{mark}".encode() for n, marks in ((n_a, ",|"), (n_b, ",;")) for mark in marks for i in range(n)]

    def tokens(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> list[bytes]:
        """All tokens in the order they are written, each with the mark behind it."""
        of_a = np.searchsorted(cut_a, np.arange(len(a)), "right")
        of_b = np.searchsorted(cut_b, np.arange(len(b)), "right")
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[cut_a - 1], last_b[cut_b - 1] = 1, 1
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.concatenate([[0], cut_b])[of_a]] = a + self.n_a * last_a
        out[np.arange(len(b)) + cut_a[of_b]] = 2 * self.n_a + b + self.n_b * last_b
        return list(map(self.table.__getitem__, out.tolist()))


@functools.lru_cache(maxsize=2)
def shown_of(n_a: int, n_b: int) -> Shown:
    """The writer's table is made once in a Python worker, not once for each document (some 10 MB)."""
    return Shown(n_a, n_b)


class Sides:
    """Both tokenizers as a task needs them: lengths of tokens, width of stored ids, pair numbers."""

    def __init__(self, left: Callable, right: Callable):
        self.left, self.right = left(), right()
        self.n_a, self.n_b = len(self.left.bytes_of), len(self.right.bytes_of)
        self.a_len = np.array([len(x) for x in self.left.bytes_of], np.int64)
        self.b_len = np.array([len(x) for x in self.right.bytes_of], np.int64)
        self.kind = "<u2" if max(self.n_a, self.n_b) <= 1 << 16 else "<u4"

    def ids(self, stored: bytes) -> np.ndarray:
        return np.frombuffer(stored, self.kind).astype(np.int64)

    def pairs(self, merge: Merge, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id pair of every link as one number."""
        return a[merge.at_a] * self.n_b + b[merge.at_b]


@functools.lru_cache(maxsize=2)
def sides_of(left: Callable, right: Callable) -> Sides:
    return Sides(left, right)


def id_width(left: Callable, right: Callable) -> int:
    return np.dtype(sides_of(left, right).kind).itemsize


def encode(docs: DataFrame, text_col: str, left: Callable, right: Callable) -> DataFrame:
    """(row, doc, a, b): the other columns, a number of the row, and both sides' ids, little-endian.

    A null or empty text, and one whose joined token bytes are not a blank and the text on both sides, has no ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = sides_of(left, right)
        for batch in batches:
            texts = batch.column("text")
            for begin, end in runs(texts, _AT_ONCE):
                own = [t or "" for t in texts[begin:end].to_pylist()]
                a_ids, b_ids = sides.left(own), sides.right(own)
                for i, text in enumerate(own):
                    plain = b" " + text.encode()
                    if not text or any(
                        b"".join(map(side.bytes_of.__getitem__, ids)) != plain
                        for side, ids in ((sides.left, a_ids[i]), (sides.right, b_ids[i]))
                    ):
                        a_ids[i], b_ids[i] = [], []
                stored = [pa.array([np.array(x, sides.kind).tobytes() for x in ids], pa.binary()) for ids in (a_ids, b_ids)]
                yield pa.RecordBatch.from_arrays([batch.column("row")[begin:end], *stored], names=["row", "a", "b"])

    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others).alias("row"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {kind}, a binary, b binary").withColumn("doc", F.monotonically_increasing_id())
    path = scratch_path(docs.sparkSession, "token-ids")
    out.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


_PIECE = {
    "doc": pa.int64(), "piece": pa.int32(), "a": pa.binary(), "b": pa.binary(), "n_a": pa.int64(), "n_b": pa.int64(),
    "lead": pa.int64(),
}


def cut_pieces(long: DataFrame, left: Callable, right: Callable, size: int) -> DataFrame:
    """Divide the merge of both sides' token ends of each document into pieces of ``size`` ends, dealt out over all tasks.

    Diagonal binary searches find where each piece begins in both lists. A piece holds its own tokens (``n_a``,
    ``n_b``), the next one of each side, and ``lead``: by how many bytes its first token of the right side begins
    later than that of the left.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = sides_of(left, right)
        for batch in batches:
            for doc, a, b in zip(*[batch.column(c) for c in ("doc", "a", "b")], strict=True):
                a, b = sides.ids(a.as_py()), sides.ids(b.as_py())
                a_ends, b_ends = np.cumsum(sides.a_len[a]), np.cumsum(sides.b_len[b])
                at = [split_point(a_ends, b_ends, d) for d in range(0, len(a) + len(b), size)] + [(len(a), len(b))]
                out = []
                for piece, ((i, j), (k, m)) in enumerate(zip(at, at[1:], strict=False)):
                    lead = (b_ends[j - 1] if j else 0) - (a_ends[i - 1] if i else 0)
                    own = [x.astype(sides.kind).tobytes() for x in (a[i : k + 1], b[j : m + 1])]
                    out.append((doc.as_py(), piece, *own, k - i, m - j, int(lead)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PIECE.values(), strict=True)], names=list(_PIECE)
                )

    names = {"int64": "long", "int32": "int", "binary": "binary"}
    kinds = ", ".join(f"{c} {names[str(t)]}" for c, t in _PIECE.items())
    return long.select("doc", "a", "b").mapInArrow(cut, kinds).repartition("doc", "piece")


def _merged_piece(sides: Sides, row: dict) -> tuple[np.ndarray, np.ndarray, Merge]:
    a, b = sides.ids(row["a"]), sides.ids(row["b"])
    shift = max(0, -row["lead"])  # so that no end is below 0
    a_ends = np.cumsum(sides.a_len[a])[: row["n_a"]] + shift
    b_ends = np.cumsum(sides.b_len[b])[: row["n_b"]] + shift + row["lead"]
    return a, b, Merge(a_ends, b_ends)


class _Run:
    """Whole documents one behind the other: at every border both sides end, so they are merged as one text."""

    def __init__(self, sides: Sides, a: list[bytes], b: list[bytes]):
        self.a, self.b = sides.ids(b"".join(a)), sides.ids(b"".join(b))
        width = np.dtype(sides.kind).itemsize
        self.n_a, self.n_b = np.array([len(x) // width for x in a], np.int64), np.array([len(x) // width for x in b], np.int64)
        a_ends = np.cumsum(sides.a_len[self.a])
        self.merge = Merge(a_ends, np.cumsum(sides.b_len[self.b]))
        borders = np.concatenate([[0], a_ends])[np.cumsum(self.n_a)]
        #: How many links, and groups, up to the end of each document.
        self.links = np.searchsorted(self.merge.ends, borders, "right")
        self.groups = np.searchsorted(self.merge.cut_ends, borders, "right")
        self.pairs = sides.pairs(self.merge, self.a, self.b)
        self.owner = np.searchsorted(borders, self.merge.ends)


def _whole_runs(batches: Iterator[pa.RecordBatch], sides: Sides) -> Iterator[tuple[pa.RecordBatch, _Run]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _DOCS_AT_ONCE):
            part = batch.slice(at, _DOCS_AT_ONCE)
            for begin, end in runs(part.column("a"), _AT_ONCE >> 2):
                own = part.slice(begin, end - begin)
                yield own, _Run(sides, own.column("a").to_pylist(), own.column("b").to_pylist())


def _split(encoded: DataFrame, left: Callable, right: Callable, size: int) -> tuple[DataFrame, DataFrame]:
    """Documents of one piece, and those of several."""
    ends = F.octet_length("a") + F.octet_length("b")
    limit = size * id_width(left, right)
    return encoded.where(ends <= limit), encoded.where(ends > limit)


def pair_counts(encoded: DataFrame, left: Callable, right: Callable, size: int = PIECE) -> DataFrame:
    """(pair, n, best): of how many documents an id pair is linked in, and whether no other pair of its left id is in more.

    Each task counts the documents of its pairs before they are moved. Pairs of a document of several pieces are made
    distinct by document first. A pair is the left id times the size of the right vocabulary, plus the right id.
    """
    whole, long = _split(encoded, left, right, size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = sides_of(left, right)
        pairs, counts, held = [], [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([np.empty(0, np.int64), *pairs]), return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, place, np.concatenate([np.empty(0, np.int64), *counts]))
            return keys, total

        for _, run in _whole_runs(batches, sides):
            own = np.unique(run.owner * (sides.n_a * sides.n_b) + run.pairs) % (sides.n_a * sides.n_b)
            keys, n = np.unique(own, return_counts=True)
            pairs.append(keys)
            counts.append(n.astype(np.int64))
            held += len(keys)
            if held > _GATHERED:
                keys, n = summed()
                pairs, counts, held = [keys], [n], len(keys)
                if held > _GATHERED // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])
                    pairs, counts, held = [], [], 0
        keys, n = summed()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = sides_of(left, right)
        for batch in batches:
            for row in batch.to_pylist():
                a, b, merge = _merged_piece(sides, row)
                keys = np.unique(sides.pairs(merge, a, b))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row["doc"])), pa.array(keys)], names=["doc", "pair"])

    of_whole = whole.select("a", "b").mapInArrow(count, "pair long, n long")
    of_long = cut_pieces(long, left, right, size).mapInArrow(pairs_of, "doc long, pair long").distinct()
    both = of_whole.unionByName(of_long.groupBy("pair").agg(F.count("*").alias("n")))
    counts = materialize(both.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    n_b = len(right().bytes_of)
    counts = counts.withColumn("a", F.expr(f"pair div {n_b}"))
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    highest = F.broadcast(highest)  # one row for each left id, at most its vocabulary
    return counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


class _Counts:
    """Looks up the most common pairs."""

    def __init__(self, held: dict[str, np.ndarray]):
        self.pair, self.n, self.best = held["pair"], held["n"], held["best"]

    def of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each link: is its pair known, its count, and whether it is its left id's best; 0 where not known."""
        keys, place = np.unique(pairs, return_inverse=True)
        if not len(self.pair):
            return np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        at = np.minimum(np.searchsorted(self.pair, keys), len(self.pair) - 1)
        known = self.pair[at] == keys
        return known[place], np.where(known, self.n[at], 0)[place], np.where(known, self.best[at], 0)[place]


def _sums(values: np.ndarray, up_to: np.ndarray) -> np.ndarray:
    """Sums of the values of each document, which end at ``up_to``; in whole numbers."""
    total = np.concatenate([[0], np.cumsum(values)])[up_to]
    return np.diff(total, prepend=0)


def _rare(owner: np.ndarray, pairs: np.ndarray, n: int) -> pa.Array:
    """For each of n documents, its pairs that are not among the most common, as often as they are linked."""
    bounds = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(bounds, pa.array(pairs, pa.int64()))


def _bits(cuts: np.ndarray, n: int) -> bytes:
    """A bit for each of n tokens: does a group end there?"""
    ends = np.zeros(n, np.uint8)
    ends[cuts - 1] = 1
    return np.packbits(ends).tobytes()


def _cuts(bits: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))) + 1


_SCORES = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
_ADDED = [part.split()[0] for part in _SCORES.split(", ")]


def align(
    docs: DataFrame,
    text_col: str = "text",
    left: Callable = default_left,
    right: Callable = default_right,
    piece: int = PIECE,
    common: int = COMMON,
    digest: bool = False,
) -> DataFrame:
    """Align the tokens of two tokenizers over every text, and score the links by how common they are in the corpus.

    Texts are encoded once and their ids stored. Byte ends of both sides are merged: every end is a link between one
    token of each side, and places where both sides end cut the tokens into groups. Documents of more than ``piece``
    ends are divided by diagonal binary searches into pieces of equal work, which are merged in any task; what the
    pieces of a document cut is stitched into its groups afterwards.

    The counts of the most common pairs (at most ``common``, by a threshold on their count) go to every task; the
    other pairs, of which each is rare by that threshold, are joined by shuffle.

    Returns all columns but the text, and n_a, n_b: tokens; n_groups; n_links; n_best: links whose pair is in as many
    documents as any of its left id; count_sum: the sum over links of the number of documents their pair is in;
    groups: ``a1,a2|b1;a3|b2`` in decimal ids, or the hex sha256 of that with ``digest``. A null or empty text, and one
    that either side does not give back byte by byte, has no tokens, zeros, and an empty ``groups``. Equal rows
    are documents of their own. An empty table gives no rows; a column named like one of these gives way to it.
    """
    kept = [c for c in docs.columns if c != text_col and c not in _ADDED]
    encoded = encode(docs.select(text_col, *[F.col(f"`{c}`") for c in kept]), text_col, left, right)
    counts = materialize(pair_counts(encoded, left, right, piece), "best-pairs")
    n_pairs, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = 1 if n_pairs <= common else total // common + 1  # at most total / least pairs are in ``least`` documents
    frequent = counts.where(F.col("n") >= least).toArrow()
    order = np.argsort(frequent["pair"].to_numpy())
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast({c: frequent[c].to_numpy()[order] for c in ("pair", "n", "best")})
    whole, long = _split(encoded, left, right, piece)

    def shown(text: bytes) -> str:
        return hashlib.sha256(text).hexdigest() if digest and text else text.decode()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, known = sides_of(left, right), _Counts(held.value)
        writer = shown_of(sides.n_a, sides.n_b)
        for batch, run in _whole_runs(batches, sides):
            is_known, n, best = known.of(run.pairs)
            tokens = writer.tokens(run.a, run.b, run.merge.cut_a, run.merge.cut_b)
            ends = np.cumsum(run.n_a + run.n_b).tolist()
            groups = [shown(b"".join(tokens[i:j])[:-1]) for i, j in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"), pa.array(run.n_a), pa.array(run.n_b), pa.array(np.diff(run.groups, prepend=0)),
                    pa.array(np.diff(run.links, prepend=0)), pa.array(_sums(best, run.links)), pa.array(_sums(n, run.links)),
                    pa.array(groups, pa.string()), _rare(run.owner[~is_known], run.pairs[~is_known], batch.num_rows),
                ],
                names=["doc", *_ADDED, "rare"],
            )

    def score_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, known = sides_of(left, right), _Counts(held.value)
        for batch in batches:
            for row in batch.to_pylist():
                a, b, merge = _merged_piece(sides, row)
                pairs = sides.pairs(merge, a, b)
                is_known, n, best = known.of(pairs)
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "doc": row["doc"], "piece": row["piece"], "n_links": len(pairs), "n_best": int(best.sum()),
                            "count_sum": int(n.sum()), "a": a[: row["n_a"]].astype(sides.kind).tobytes(),
                            "b": b[: row["n_b"]].astype(sides.kind).tobytes(), "cut_a": _bits(merge.cut_a, row["n_a"]),
                            "cut_b": _bits(merge.cut_b, row["n_b"]), "rare": pairs[~is_known].tolist(),
                        }
                    ],
                    schema=_SCORED_PIECE,
                )

    def stitch(pieces: pa.Table) -> pa.Table:
        sides = sides_of(left, right)
        rows = pieces.sort_by("piece").to_pylist()
        cut_a, cut_b, n_a, n_b = [], [], 0, 0
        for row in rows:
            cut_a.append(_cuts(row["cut_a"]) + n_a)
            cut_b.append(_cuts(row["cut_b"]) + n_b)
            n_a += len(sides.ids(row["a"]))
            n_b += len(sides.ids(row["b"]))
        a, b = sides.ids(b"".join(r["a"] for r in rows)), sides.ids(b"".join(r["b"] for r in rows))
        cut_a, cut_b = np.concatenate(cut_a), np.concatenate(cut_b)
        text = b"".join(shown_of(sides.n_a, sides.n_b).tokens(a, b, cut_a, cut_b))[:-1]
        sums = [sum(r[c] for r in rows) for c in ("n_links", "n_best", "count_sum")]
        values = [rows[0]["doc"], n_a, n_b, len(cut_a), *sums, shown(text), [x for r in rows for x in r["rare"]]]
        kinds = [pa.int64()] * 7 + [pa.string(), pa.list_(pa.int64())]
        return pa.table([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["doc", *_ADDED, "rare"])

    scored = f"doc long, {_SCORES}, rare array<bigint>"
    of_whole = whole.select("doc", "a", "b").mapInArrow(score, scored)
    parts = cut_pieces(long, left, right, piece).mapInArrow(
        score_piece,
        "doc long, piece int, n_links long, n_best long, count_sum long, a binary, b binary, cut_a binary, "
        "cut_b binary, rare array<bigint>",
    )
    of_long = parts.groupBy("doc").applyInArrow(stitch, scored)  # the pieces of one document
    rows = materialize(of_whole.unionByName(of_long), "aligned")
    if least > 1:
        rare = rows.select("doc", F.explode("rare").alias("pair")).groupBy("doc", "pair").agg(F.count("*").alias("times"))
        rare = rare.join(counts.where(F.col("n") < least).hint("shuffle_merge"), "pair").groupBy("doc").agg(
            F.sum(F.col("times") * F.col("n")).alias("more_sum"),
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        )
        more = {"n_best": "more_best", "count_sum": "more_sum"}
        rows = rows.join(rare, "doc", "left").withColumns({c: F.col(c) + F.coalesce(m, F.lit(0)) for c, m in more.items()})
    return encoded.select("row", "doc").join(rows.select("doc", *_ADDED), "doc").select(
        *[F.col(f"row.`{c}`").alias(c) for c in kept], *_ADDED
    )


_SCORED_PIECE = pa.schema(
    [("doc", pa.int64()), ("piece", pa.int32()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64())]
    + [(c, pa.binary()) for c in ("a", "b", "cut_a", "cut_b")] + [("rare", pa.list_(pa.int64()))]
)


@query()
def op13_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the alignment of its two tokenizations."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align(docs, digest=True).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256")
    )
