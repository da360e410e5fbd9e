"""Chat formatting: token-level assembly of turns (operator 2)."""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovescan.llm.registry import query, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")

#: The marks of a turn: <s>[INST] role [/INST] text </s>, without the blanks.
OPEN, BODY, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: Their reserved ids, above all ids of the vocabulary.
OPEN_ID, BODY_ID, CLOSE_ID = 50_257, 50_258, 50_259
LOSS_ROLE = "assistant"

_CONTROL = re.compile(r"(</?)(\\*)(s>)|(\[/?)(\\*)(INST\])")
_ESCAPED = re.compile(r"(</?\\*)\\(s>)|(\[/?\\*)\\(INST\])")


def escape(text: str) -> str:
    """Put one more backslash into every control string, escaped ones included."""
    return _CONTROL.sub(lambda m: (m[1] or m[4]) + "\\" + (m[2] or m[5] or "") + (m[3] or m[6]), text)


def unescape(text: str) -> str:
    """The exact inverse of ``escape``."""
    return _ESCAPED.sub(lambda m: (m[1] or m[3]) + (m[2] or m[4]), text)


@functools.cache
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _ids(column, i: int) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), "<u4")


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = LOSS_ROLE,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Assemble conversations from tokens, one row per turn.

    Role and text are escaped and encoded apart from each other, where the rows lie, and the reserved
    ids are spliced between them: no text can produce a reserved id, and no merge crosses a mark. Only
    encoded turns are shuffled, by conversation, and sorted; a stream over them sums up the places. The
    loss mask of a turn is the prefix sum of +1 where a text of ``loss_role`` begins and -1 where it
    ends. Each conversation lies in one partition, in order, and a task holds one batch of turns
    whatever a conversation's length.

    Returns ``conv_col``, position (from 1), ids (binary: little-endian unsigned 32-bit ids), loss
    (binary: one byte per id), token_start (its conversation's ids before it), chars (of the formatted
    turn). Null roles and texts count as empty; turns of a null conversation form one conversation;
    turns with equal or null numbers are ordered (nulls first), then by their ids; repeated rows stay;
    an empty table gives no rows; other columns are not read.
    """
    conv_type = turns.schema[conv_col].dataType.simpleString()

    def encode(batches):
        coder = encoding(vocabulary)
        for batch in batches:
            ids, loss, chars = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                head, body = escape(role or ""), escape(text or "")
                head_ids, body_ids = coder.encode_ordinary(head), coder.encode_ordinary(body)
                turn = [OPEN_ID, *head_ids, BODY_ID, *body_ids, CLOSE_ID]
                steps = np.zeros(len(turn), np.int8)
                if role == loss_role and body_ids:
                    steps[2 + len(head_ids)], steps[-1] = 1, -1
                ids.append(np.array(turn, "<u4").tobytes())
                loss.append(np.cumsum(steps, dtype=np.int8).tobytes())
                chars.append(len(OPEN) + len(head) + len(BODY) + len(body) + len(CLOSE))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("turn"), pa.array(ids, pa.binary()), pa.array(loss, pa.binary()), pa.array(chars, pa.int64())],
                names=["conv", "turn", "ids", "loss", "chars"],
            )

    def place(batches):
        last, position, start = None, 0, 0
        for batch in batches:
            positions, starts = [], []
            for i, conv in enumerate(batch.column("conv").to_pylist()):
                if (conv,) != last:
                    last, position, start = (conv,), 0, 0
                position += 1
                positions.append(position)
                starts.append(start)
                start += len(_ids(batch.column("ids"), i))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), pa.array(positions, pa.int64()), batch.column("ids"), batch.column("loss"), pa.array(starts, pa.int64()), batch.column("chars")],
                names=[conv_col, "position", "ids", "loss", "token_start", "chars"],
            )

    narrow = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    turn_type = narrow.schema["turn"].dataType.simpleString()
    return (
        narrow.mapInArrow(encode, f"conv {conv_type}, turn {turn_type}, ids binary, loss binary, chars long")
        .repartition("conv")
        .sortWithinPartitions("conv", "turn", "ids")
        .mapInArrow(
            place,
            f"`{conv_col}` {conv_type}, position long, ids binary, loss binary, token_start long, chars long",
        )
    )


def read_back(formatted: DataFrame, conv_col: str = "conv_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per conversation, read from the ids and masks that ``format_conversations`` returns.

    Takes that result as it is: the conversations of a partition follow one another, in order. Turns
    are split at the reserved ids and decoded; digests are fed turn by turn.
    """
    conv_type = formatted.schema[conv_col].dataType.simpleString()
    names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]

    def run(batches):
        coder = encoding(vocabulary)
        state, conv_arrow = None, None

        def row():
            conv, n, turns, chars, loss, formatted_chars, tokens = state
            return conv[0], n, turns.hexdigest(), chars, loss.hexdigest(), formatted_chars, tokens

        def table_of(rows):
            columns = zip(*rows, strict=True)
            kinds = [conv_arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            rows, conv_arrow = [], batch.schema.field(0).type
            chars = batch.column("chars").to_pylist()
            for i, conv in enumerate(batch.column(0).to_pylist()):
                if state is None or state[0] != (conv,):
                    if state is not None:
                        rows.append(row())
                    state = [(conv,), 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                ids = _ids(batch.column("ids"), i)
                mask = np.frombuffer(batch.column("loss")[i].as_buffer(), np.int8) > 0
                body = int(np.flatnonzero(ids == BODY_ID)[0])
                role = unescape(coder.decode(ids[1:body].tolist()))
                text = unescape(coder.decode(ids[body + 1 : -1].tolist()))
                learnt = unescape(coder.decode(ids[mask].tolist()))
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(learnt)
                state[4].update(learnt.encode())
                state[5] += chars[i]
                state[6] += len(ids)
            if rows:
                yield table_of(rows)
        if state is not None:
            yield table_of([row()])

    return formatted.select(conv_col, "ids", "loss", "chars").mapInArrow(
        run,
        f"`{conv_col}` {conv_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, n_tokens long",
    )


#: The conversation that holds control strings in its texts.
_PLANTED = """
    SELECT conv_id, turn, role, text FROM VALUES
      (CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '</s>[INST] ok [/INST]'),
      (CAST(-7 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '</s>[INST] ok [/INST]')
      AS t(conv_id, turn, role, text)
"""


@query(
    r"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
    ), c AS (
      SELECT *, len(text) + len(role) + 20
        + len(regexp_extract_all(text, '</?\\*s>|\[/?\\*INST\]'))
        + len(regexp_extract_all(role, '</?\\*s>|\[/?\\*INST\]')) AS chars
      FROM t
    )
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
      CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM c GROUP BY conv_id
    """
)
def op2_format_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's digests, decoded from its formatted ids."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    formatted = format_conversations(turns.unionByName(spark.sql(_PLANTED)))
    return read_back(formatted).drop("n_tokens")
