import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trovescan.functions import text, vectors
from trovescan.operators.chunks import chunk_count, chunk_documents
from trovescan.operators.embed import hash_embed

BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0     　"


def test_blanks_are_those_of_python(spark):
    codes = [c for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    rows = [(c, f"a{chr(c)}b", f"{chr(c)}x{chr(c)}") for c in codes]
    df = spark.createDataFrame(rows, "c int, inner string, outer string")
    got = df.select("c", text.words(F.col("inner")).alias("w"), text.strip(F.col("outer")).alias("s"))
    wrong = [
        r["c"]
        for r in got.collect()
        if r["w"] != re.findall(r"\S+", f"a{chr(r['c'])}b") or r["s"] != f"{chr(r['c'])}x{chr(r['c'])}".strip()
    ]
    assert wrong == []


def windows(body, size, stride):
    """Word windows by definition: those starting before the first that reaches the end."""
    found = (body or "").split()
    starts = [s for s in range(0, len(found), stride) if s == 0 or s - stride + size < len(found)]
    return [" ".join(found[s : s + size]) for s in starts]


@pytest.mark.parametrize("size,stride", [(240, 160), (5, 3), (4, 4), (3, 5), (1, 1)])
def test_chunks(spark, size, stride):
    texts = [None, "", BLANK, "one"] + [
        " ".join(f"w{i}" for i in range(n)) for n in (2, 3, 4, 5, 6, 7, 8, 9, 11, 240, 241, 400, 401, 560, 561)
    ] + ["a\xa0b\x85c\x1cd　e​f᠎g", "  lead\n\ntrail \t"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in chunk_documents(df, "text", size, stride).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {i: w for i, t in enumerate(texts) if (w := windows(t, size, stride))}


def test_snippet_counts_code_points(spark):
    texts = ["x" * 219, "x" * 220, "x" * 221, "\U0001f600" * 221, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(text.snippet(F.col("t"))).collect()]
    assert got == [t if len(t) <= 220 else t[:220] + "…" for t in texts]
    assert [r[0] for r in df.select(text.snippet(F.col("t"), 0)).collect()] == texts


def test_doc_text(spark):
    rows = [("T", "b"), (None, "b"), ("T", None), (None, None), (" \n", "\xa0b　"), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(text.doc_text(F.col("a"), F.col("b"))).collect()]
    assert got == [((a or "") + "\n\n" + (b or "")).strip() for a, b in rows]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.floats(-10, 10, width=32), min_size=3, max_size=3), min_size=1, max_size=20))
def test_normalize(spark, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<float>")
    got = df.select("i", vectors.l2_normalize(F.col("v")).alias("u")).orderBy("i").collect()
    for row, r in zip(rows, got):
        norm = math.sqrt(sum(x * x for x in row))
        want = [x / norm for x in row] if norm > 0 else row
        assert np.allclose(r["u"], want, atol=1e-12)


def test_hash_embed_survives_filters_on_its_result(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(3000))), (2, ""), (3, None)], "id int, text string")
    got = hash_embed(df).where(F.size("embedding") > 0).where(F.col("embedding")[0] >= 0)
    rows = {r["id"]: r["embedding"] for r in got.collect()}
    assert math.isclose(sum(x * x for x in rows[1]), 1.0)
    assert rows[2] == rows[3] == [0.0] * 64


def test_counting_chunks_reads_a_text_once(spark):
    docs = spark.createDataFrame([(" ".join("x" * 401),), (" a b　",), (" \x85\x1c",), (None,)], "text string")
    counted = docs.select(chunk_count(F.col("text")).alias("n"))
    assert [r.n for r in counted.collect()] == [3, 1, 0, 0]
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 1


def test_every_blank_parts_words_and_nothing_else_does(spark):
    signs = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(f"a{s}b", len(f"a{s}b".split())) for s in signs], "text string, n int")
    counted = F.regexp_count("text", F.lit(text.NOT_BLANKS))
    assert rows.where((F.size(text.words(F.col("text"))) != F.col("n")) | (counted != F.col("n"))).isEmpty()
