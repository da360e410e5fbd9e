"""Packing token sequences by length classes, each worker on its own (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovescan.llm.registry import query, table
from trovescan.llm.tokens import VOCABULARY, word_encoder

CAPACITY = 2048
#: How often a rest is halved: with 5, cuts fall at 1024, 512, 256, 128 and 64 ids.
HALVINGS = 5
END_ID = 1


def cut(length: int, capacity: int, halvings: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document: full sequences, then binary fractions, then a tail."""
    start = 0
    while length - start >= capacity:
        yield start, capacity
        start += capacity
    for i in range(1, halvings + 1):
        if length - start >= capacity >> i:
            yield start, capacity >> i
            start += capacity >> i
    if start < length:
        yield start, length - start


class _Bins:
    """The open bins of one worker: at most one for each class.

    Class k holds lengths above capacity / (k + 1), up to capacity / k, and its bins take k pieces.
    """

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id, self.open = capacity, first_id, {}

    def add(self, piece: tuple) -> list[tuple]:
        """Takes (doc_id, start, ids, doc_tokens); returns what leaves, with (sequence_id, offset)."""
        k = self.capacity // len(piece[2])
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) < k:
            return []
        del self.open[k]
        return self._sequence(held)

    def _sequence(self, pieces: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for piece in pieces:
            out.append((*piece, self.next_id, offset))
            offset += len(piece[2])
        self.next_id += 1
        return out

    def close(self) -> list[tuple]:
        """Joins the pieces of unfilled bins and cuts them anew: full sequences, then powers of two."""
        out, rest = [], [p for k in sorted(self.open) for p in self.open[k]]
        left = sum(len(p[2]) for p in rest)
        while left:
            size = min(self.capacity, 1 << (left.bit_length() - 1))
            left -= size
            taken = []
            while size:
                doc, start, ids, total = rest.pop(0)
                if len(ids) > size:
                    rest.insert(0, (doc, start + size, ids[size:], total))
                    ids = ids[:size]
                taken.append((doc, start, ids, total))
                size -= len(ids)
            out += self._sequence(taken)
        return out


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    halvings: int = HALVINGS,
    end_id: int = END_ID,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` ids (a power of two).

    A document's ids are those of its whole text, then ``end_id``. It is cut at binary fractions of
    the capacity, which fill the bins of their classes exactly; only tails below the last fraction
    leave padding, under one part in 2 ** halvings of their bins. Each task fills the bins of its own
    rows and, at its end, cuts what is left in open bins into full sequences and then sequences whose
    lengths are powers of two. There is no shuffle; a task holds at most one open bin for each class.

    Returns one row per piece: ``id_col``, start, length, ids (binary: little-endian unsigned 32-bit
    ids), doc_tokens, sequence_id, offset. A null or empty text gives one piece with the end id; a
    null id stays null; repeated rows are packed as often as they occur; an empty table gives no rows;
    other columns are not read. Sequence ids depend on how the input is split, nothing else does.
    """
    if capacity & (capacity - 1) or capacity >> halvings < 1:
        raise ValueError("the capacity must be a power of two, and large enough for the halvings")
    id_type = docs.schema[id_col].dataType

    def run(batches):
        encode = word_encoder(vocabulary)
        bins = _Bins(capacity, TaskContext.get().partitionId() << 33)

        def packed(rows):
            doc, start, ids, total, sequence, offset = zip(*rows, strict=True) if rows else [()] * 6
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(doc, id_arrow),
                    pa.array(start, pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                    pa.array(total, pa.int64()),
                    pa.array(sequence, pa.int64()),
                    pa.array(offset, pa.int64()),
                ],
                names=names,
            )

        id_arrow = None
        for batch in batches:
            id_arrow = batch.schema.field(0).type
            rows, size = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py()), np.uint32(end_id)).astype(np.uint32)
                for start, length in cut(len(ids), capacity, halvings):
                    rows += bins.add((doc, start, ids[start : start + length], len(ids)))
                size += len(ids)
                if size > 1 << 21:
                    yield packed(rows)
                    rows, size = [], 0
            yield packed(rows)
        if bins.open:
            yield packed(bins.close())

    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    schema = (
        f"`{id_col}` {id_type.simpleString()}, start long, length long, ids binary, "
        "doc_tokens long, sequence_id long, offset long"
    )
    return docs.select(id_col, text_col).mapInArrow(run, schema)


@query()
def op3_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, with the checksum of its ids and its place in a sequence."""
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
