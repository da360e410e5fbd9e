"""Operators of the training-data package against plain versions, on edge cases and real rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trovescan.llm import chat, jaccard, licenses, mixing, neighbours, packing, pii, quality, repeats, topk
from trovescan.llm.catalog import CHECKS, QUERIES
from trovescan.llm.components import components
from trovescan.llm.shingles import shingle_set
from trovescan.llm.tokens import word_encoder
from trovescan.session import materialize
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_agrees_with_sql(spark, name):
    result = compare(spark, connect(SF), SF, QUERIES[name], CHECKS[name])
    assert result["problem"] is None
    assert not result["types"]


def edge_rows():
    rng = random.Random(5)
    words = ["mail", "of", "Ärger", "x1", "the", "a@b.co", "10.0.0.1", "+49 170 1234567", "4111 1111 1111 1111", "cc", "by", "GNU", "General", "Public", "License", "3", "all", "rights", "reserved", "l'été", "don't", "𝒳", "\t", "##!"]
    texts = [None, "", " ", "\n\n", "one", "One two", "a" * 30_000, " ".join(rng.choice(words) for _ in range(30_000))]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += [t + " end" for t in texts[-5:]] + texts[-3:]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None, "Ä"]), len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[-1], rows[-1], (None, "the null id", None, None, 3), (7, "same id, other text " * 20, "en", "a", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(edge_rows(), DOCS)
    extra = {c: F.lit(1) for c in ("id", "version", "node", "n", "row", "kept", "size", "spans", "key", "start", "removed", "_id", "at", "v", "sig")}
    return df.withColumns(extra).repartition(5)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# tokens and packing


def test_word_encoder_equals_the_library():
    encode, rng = word_encoder(), random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("aAbz 'strevmld012!\"#,.;\n\t\réÈçÀßÿ<|>x-_`~^œΣς́中\0") for _ in range(rng.randint(0, 20)))
        assert encode(text).tolist() == encode.library.encode(text, add_special_tokens=False).ids
    assert encode("<|endoftext|>").tolist() == [49407]


@pytest.mark.parametrize("table", ["docs", "real"])
def test_packing_holds_every_id_once(request, table):
    df = request.getfixturevalue(table)
    rows = packing.pack(df).collect()
    encode, ids_of, pieces, sequences = word_encoder(), Counter(), defaultdict(list), defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        ids_of[(r.doc_id, np.append(encode(r.text), 1).astype("<u4").tobytes())] += 1
    for r in rows:
        assert r.length == len(r.ids) // 4 > 0
        pieces[(r.doc_id, r.doc_tokens)].append(r)
        sequences[r.sequence_id].append(r)
    found = Counter()
    for (doc, total), own in pieces.items():
        by_start = defaultdict(list)
        for r in own:
            by_start[r.start].append(r)
        while by_start.get(0):
            at, text = 0, b""
            while at < total:
                r = by_start[at].pop()
                text, at = text + bytes(r.ids), at + r.length
            found[(doc, text)] += 1
    if table == "real":
        assert found == ids_of
    assert sum(len(k[1]) * n for k, n in found.items()) == sum(len(k[1]) * n for k, n in ids_of.items())
    padding = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        ends = [0, *np.cumsum([r.length for r in own]).tolist()]
        assert [r.offset for r in own] == ends[:-1] and ends[-1] <= 2048
        padding += 0 if ends[-1] & (ends[-1] - 1) == 0 else 2048 - ends[-1]
    assert padding <= 0.02 * sum(r.length for r in rows)


def test_packing_of_nothing(none):
    assert packing.pack(none).count() == 0


def test_query_checksums(spark):
    row = packing.pack(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).withColumn("crc", F.crc32("ids")).first()
    assert row.crc == zlib.crc32(row.ids)


# chat


def test_escape_is_reversible():
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice(["<", "/", "s", ">", "[", "]", "INST", "\\", "</s>", "[/INST]", "x", "\n"]) for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text
        assert not re.search(r"</?s>|\[/?INST\]", chat.escape(text))


def test_chat_edge_cases(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST]\\s>"), (1, 1, "assistant", "</s>[INST]\\s>"), (1, None, None, None),
            (None, 3, "assistant", "x" * 50_000), (2, 0, "[INST]", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(2))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    turns = [("", ""), ("user", "hi"), ("assistant", rows[1][3]), ("assistant", rows[1][3])]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256((rows[1][3] * 2).encode()).hexdigest()
    assert got[None].loss_chars == 50_000 and got[2].loss_chars == 0 and got[2].n_turns == 1
    placed = chat.format_conversations(df).where("conv_id = 1").orderBy("position").collect()
    assert [p.token_start for p in placed] == np.cumsum([0, *[len(p.ids) // 4 for p in placed]])[:-1].tolist()
    assert chat.read_back(chat.format_conversations(df.where("false"))).count() == 0


# personal data


def plain_spans(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(x) for x in m[0] if x.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_base_spans_equal_the_plain_expressions(spark, docs, real):
    rng = random.Random(9)
    marks = ["a", "B", "@", ".", "_", "1", "25", "255", "256", "0", "+", "-", " ", "(", ")", "x@y.z", "\n", "é", "𝒳", "4111111111111111"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(1, 40))) for _ in range(4000)] + ["1" * 50_000, "a" * 50_000, "1." * 20_000]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    for df in (made, docs, real):
        texts_of = defaultdict(list)
        for r in df.select("doc_id", "text").collect():
            texts_of[r.doc_id].append(plain_spans(r.text))
        for r in pii.find_personal_data(df).collect():
            assert [(s.kind, s.start, s.end) for s in r.spans if s.found == "base"] in texts_of[r.doc_id]


def test_personal_data_query(spark, real):
    texts = {r.doc_id: plain_spans(r.text) for r in real.collect()}
    rows = QUERIES["op4_personal_data"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in texts[r.doc_id]) for kind in pii.KINDS]
        assert set(told.split(",")) - {""} <= set(r.spans.split(","))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_query_writes_all_its_columns(spark, name, tmp_path):
    QUERIES[name](spark, SF).write.parquet(str(tmp_path / name))


def test_contexts_discover(spark):
    rows = [(i, f"please call phone: +49 170 1234{i:03d} now") for i in range(20)] + [(50, "please call phone: +49 170 12 or"), (51, "born in 1999")]
    rows += [(60 + i, f"server host address 10.0.0.{i} is up") for i in range(9)] + [(70, "server host address 10.0.0.999 is up")]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.kind, s.found) for s in got[70]] == [("ip", "pattern")]
    assert not got[51]
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_contexts_hold_words_with_digits(spark):
    rows = [(i, f"id 7 host 10.0.0.{i}") for i in range(9)] + [(70, "id 7 host 10.0.0.999"), (71, "10.0.0.1 id 7 host 10.0.0.998")]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.kind, s.start, s.found) for s in got[70]] == [("ip", 10, "pattern")]
    assert [(s.kind, s.start, s.found) for s in got[71]] == [("ip", 0, "base"), ("ip", 19, "pattern")]


def test_contexts_find_other_forms(spark):
    rows = [(i, f"please call phone: +49 170 1234{i:03d} now, or write mail to user{i}@host{i}.com today") for i in range(20)]
    rows += [(100, "please call phone: (017) 555-7713 now"), (101, "please call phone: 030 1234567 now"), (102, "you may call phone: 0301234567 soon")]
    rows += [(103, "write mail to bob(at)host.com today"), (104, "please write mail to bob_smith@localhost")]
    clean = ["she was born in 1999 and moved in 2003", "call phone: 42", "write mail to nobody today", "version 1.2.3 has 17 parts, 20 of them new", "(at) home", ""]
    rows += [(200 + i, t) for i, t in enumerate(clean)] + [(300, None)]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    told = {i: [(s.kind, texts[i][s.start : s.end], s.found) for s in got[i]] for i in got}
    assert told[100] == [("phone", "(017) 555-7713", "pattern")] and told[101] == [("phone", "030 1234567", "pattern")]
    assert told[102] == [("phone", "0301234567", "pattern")]
    assert told[103] == [("email", "bob(at)host.com", "pattern")] and told[104] == [("email", "bob_smith@localhost", "pattern")]
    assert not any(told[i] for i in told if i >= 200)


def plain_discoveries(pairs, rounds, confidence, support):
    """The graph's scores, written down: pairs are (value, shape, pattern, kind or None)."""
    seeds = {v: k for v, _, _, k in pairs if k}
    seed_shape = {v: s for v, s, _, k in pairs if k}
    by_kind = Counter(seeds.values())
    shapes = {(k, s) for (k, s), n in Counter((k, seed_shape[v]) for v, k in seeds.items()).items() if n >= pii.SHAPE_SHARE * by_kind[k]}
    values = defaultdict(set)
    for v, _, p, _ in pairs:
        values[p].add(v)
    scores = {(v, k): 1.0 for v, k in seeds.items()}
    for _ in range(rounds):
        trust = {(p, k): sum(scores.get((v, k), 0.0) for v in values[p]) / len(values[p]) for p in values for k in by_kind}
        scores = {(v, k): 1.0 for v, k in seeds.items()}
        for v, s, p, kind in pairs:
            if v not in seeds:
                for k in by_kind:
                    if (k, s) in shapes and trust[p, k]:
                        scores[v, k] = max(scores.get((v, k), 0.0), trust[p, k])
    support_of = Counter((p, k) for _, _, p, k in pairs if k)
    good = {}
    for (p, k), t in sorted(trust.items()):
        if t >= confidence and support_of[p, k] >= support and (p not in good or (t, k) > good[p]):
            good[p] = (t, k)
    return {p: k for p, (_, k) in good.items()}


def test_discoveries_equal_their_definition(spark):
    rng = random.Random(6)
    kinds = {f"s{i}": rng.choice(["phone", "email"]) for i in range(40)}
    shape = {v: rng.choice(["at", "digits"] if i % 9 else ["word"]) for i, v in enumerate([*kinds, *[f"o{i}" for i in range(40)]])}
    edges = {(rng.choice(list(shape)), f"p{rng.randrange(25) if rng.random() < 0.6 else rng.randrange(4)}") for _ in range(300)}
    pairs = [(v, shape[v], p, kinds.get(v)) for v, p in sorted(edges)]
    df = spark.createDataFrame(pairs, "value string, shape string, pattern string, kind string")
    for rounds, confidence, support in ((3, 0.9, 3), (1, 0.4, 1), (2, 0.5, 2)):
        got = {r.pattern: r.kind for r in pii._discoveries(df, rounds, confidence, support).collect()}
        assert got == plain_discoveries(pairs, rounds, confidence, support)
    assert got


def test_very_many_matches_in_one_text(spark):
    text = " ".join(f"n{i} 10.0.{i % 256}.{i // 256 % 256} é" for i in range(20_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    found = materialize(df.join(pii.find_personal_data(df), "doc_id"), "many")
    masked = found.select(pii.mask(F.col("text"), F.col("spans")).alias("text"), F.size("spans").alias("n")).first()
    assert time.time() - start < 120
    assert masked.n == 20_000 and masked.text == re.sub(r"10\.0\.[0-9]+\.[0-9]+", "[IP]", text)


def test_mask_of_overlapping_spans(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("ab é𝒳\n") for _ in range(rng.choice([0, 5, 40, 2500])))
        spans = [(rng.choice(pii.KINDS), *sorted(rng.sample(range(len(text) + 1), 2))) for _ in range(rng.randint(0, 6))] if text else []
        rows.append((i, text, [{"kind": k, "start": a, "end": b} for k, a, b in spans]))
    df = spark.createDataFrame(rows, "id long, text string, spans array<struct<kind:string,start:int,end:int>>")
    for r in df.select("text", "spans", pii.mask(F.col("text"), F.col("spans")).alias("got")).collect():
        at, out = 0, ""
        for s in sorted(r.spans, key=lambda s: (s.start, -s.end, s.kind)):
            if s.start >= at:
                out += r.text[at : s.start] + f"[{s.kind.upper()}]"
            at = max(at, s.end)
        assert r.got == (out + r.text[at:] if r.spans else r.text)


def test_mask(spark):
    df = spark.createDataFrame([(1, "é write a@b.co, or +49 170 1234567!"), (2, None), (3, "clean")], "doc_id long, text string")
    joined = df.join(pii.find_personal_data(df), "doc_id").orderBy("doc_id")
    got = [r[0] for r in joined.select(pii.mask(F.col("text"), F.col("spans"))).collect()]
    assert got == ["é write [EMAIL], or [PHONE]!", None, "clean"]


# licenses


def plain_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_license_base_equals_the_plain_scan(spark, docs, real):
    assert len(licenses.build_rules()) > 300
    for df in (docs, real):
        wanted = defaultdict(list)
        for r in df.select("doc_id", "text").collect():
            wanted[r.doc_id].append(plain_licenses(r.text))
        for r in licenses.scan_licenses(df).collect():
            assert (r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels)) in wanted[r.doc_id]
            assert set(r.base_labels) <= set(r.labels) and r.labels == sorted(set(r.labels)) and 0 <= r.score <= 1


def test_license_rules_and_suppression(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "mit der License", "GNU General Public License, version 3. CC BY-NC 4.0", "all rights reserved " * 2000]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in got[:4]] == [["apache-2.0"], ["mit"], [], ["cc-by", "cc-by-nc", "gpl", "gpl-3.0"]]
    assert [(d.start, d.end) for d in got[0].detections] == [(0, 8)]
    assert got[4].n_base == 2000 and got[4].score == 1.0


SHORT_LINES = {
    "apache-2.0": "Apache-2.0", "apache-1.1": "Apache-1.1", "mit-0": "MIT-0", "mit": "MIT", "x11": "X11", "isc": "ISC", "bsd": "BSD",
    "bsd-2-clause": "BSD-2-Clause", "bsd-3-clause": "BSD-3-Clause", "bsd-4-clause": "BSD-4-Clause", "agpl-3.0": "AGPL-3.0-or-later",
    "agpl": "AGPL", "lgpl-2.1": "LGPL-2.1-only", "lgpl-2.0": "LGPL-2.0", "lgpl-3.0": "LGPL-3.0", "lgpl": "LGPL", "gpl-1.0": "GPL-1.0",
    "gpl-2.0": "GPL-2.0-or-later", "gpl-3.0": "GPL-3.0-only", "gpl": "GPL", "gfdl": "GFDL-1.3", "mpl-1.1": "MPL-1.1", "mpl-2.0": "MPL-2.0",
    "mpl": "MPL", "epl-1.0": "EPL-1.0", "epl-2.0": "EPL-2.0", "epl": "EPL", "cddl": "CDDL-1.0", "eupl": "EUPL-1.2",
    "artistic-1.0": "Artistic-1.0", "artistic-2.0": "Artistic-2.0", "artistic": "Artistic License", "bsl-1.0": "BSL-1.0", "zlib": "Zlib",
    "unlicense": "Unlicense", "wtfpl": "WTFPL", "python": "PSF-2.0", "postgresql": "PostgreSQL", "openssl": "OpenSSL", "ofl-1.1": "OFL-1.1",
    "odbl": "ODbL-1.0", "cc0": "CC0-1.0", "cc-by-nc-nd": "CC-BY-NC-ND-4.0", "cc-by-nc-sa": "CC-BY-NC-SA-4.0", "cc-by-nc": "CC-BY-NC-4.0",
    "cc-by-nd": "CC-BY-ND-4.0", "cc-by-sa": "CC-BY-SA-4.0", "cc-by": "CC-BY-4.0", "apache": "Apache License",
}


def test_license_short_names(spark):
    assert set(SHORT_LINES) == {label for label, _, _ in licenses.NAMES + licenses.SHORT}
    lines = [(x, f"{form} {name}") for x, name in SHORT_LINES.items() for form in ("SPDX-License-Identifier:", "# code licensed under")]
    lines += [("gpl-3.0", "Released under GPLv3."), ("apache-2.0", "is licensed under Apache 2.0"), ("mit", "published under the MIT")]
    plain = ["Er kam mit ihm, under boost 2", "apache 2 helicopters", "the mit and the isc of zlib"]
    df = spark.createDataFrame([*lines, *[(None, t) for t in plain]], "doc_id string, text string")
    for r in licenses.scan_licenses(df.select(F.struct("doc_id", "text").alias("doc_id"), "text")).collect():
        label, text = r.doc_id
        assert [d.label for d in r.detections] == ([label] if label else []), text
        assert not label or (r.score > 0 and label in r.labels)


# mixing


def test_mix(spark, docs, none, real):
    for df in (docs, real):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count()
        by = defaultdict(list)
        for r in rows:
            assert 0 <= r.taken <= 2 * r.size
            by[r.source].append(r)
        total = sum(r.size for r in rows)
        assert math.isclose(sum(own[0].target for own in by.values()), 1.5 * total)
        for own in by.values():
            assert own[0].source_size == sum(r.size for r in own) and own[0].target <= 2 * own[0].source_size + 1e-6
            assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
        again = mixing.mix(df.repartition(3)).collect()
        assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert mixing.mix(none).count() == 0


def test_mix_of_one_repeated_row(spark):
    df = spark.createDataFrame([(1, "a b c d", "s")] * 100 + [(2, "x " * 1000, "t")], "doc_id long, text string, source string")
    rows = mixing.mix(df, share=0.3).collect()
    for s in "st":
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1000


# repeats


def test_repeats(spark, docs, none):
    line = "one two three four five six seven eight"
    rows = [(2, f"{line}\nmine\n{line.upper()}  "), (1, f"first\n{line}"), (3, None), (4, ""), (1, f"first\n{line}"), (None, f"é\n{line}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cuts", F.lit(1))
    got = Counter((r.doc_id, r.text, tuple(tuple(x) for x in r.removed), r.cuts) for r in repeats.remove_repeats(df).collect())
    n = len(line)
    assert got == Counter({(2, "mine", ((0, n), (n + 6, 2 * n + 8)), 1): 1, (1, "first", ((6, 6 + n),), 1): 2, (3, None, (), 1): 1,
                           (4, "", (), 1): 1, (None, f"é\n{line}", (), 1): 1})
    assert repeats.remove_repeats(docs).count() == docs.count() and repeats.remove_repeats(none).count() == 0


# vectors


def vectors_with_faults(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 16)).astype(float)
    rows = [(i, base[i % 280].tolist(), i) for i in range(300)]
    rows += [(1000, None, 0), (1001, [float("nan")] * 16, 0), (1002, [None] * 16, 0), (1003, [], 0), (1005, [0.0] * 16, 0), (None, base[0].tolist(), 0), (5, base[5].tolist(), 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long")


def plain_ranks(rows, asked, k, score):
    """Each asking row's k best of all other rows, ties by id, a null id first."""
    out = []
    for i, (q_id, q) in enumerate(rows):
        if asked(q_id):
            scores = [(-score(q, v), v_id is not None, v_id or 0, v_id) for j, (v_id, v) in enumerate(rows) if j != i]
            out += [(q_id, n + 1, s[3], -s[0]) for n, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return Counter(out)


def usable_rows(df, nonzero):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in df.collect() if r.embedding and None not in r.embedding]
    return [(i, v) for i, v in rows if np.isfinite(v).all() and (v.any() or not nonzero)]


def repeated_vectors(spark):
    """Rows that share an id, equal rows, rows with a null id."""
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(0, 30)) if rng.random() < 0.8 else None, rng.integers(-2, 3, 4).astype(float).tolist()) for _ in range(150)]
    return spark.createDataFrame(rows + rows[:20] * 2 + [(20, [1.0, 1.0, 0.0, 1.0])] * 40, "vec_id long, embedding array<double>")


def test_exact_top_k(spark):
    for df, k in ((vectors_with_faults(spark), 7), (repeated_vectors(spark), 5)):
        floored = [(i, np.floor(64 * v)) for i, v in usable_rows(df, False)]
        wanted = plain_ranks(floored, lambda i: i is not None and i % 20 == 0, k, lambda a, b: int(a @ b))
        got = topk.exact_top_k(df, df.where("vec_id % 20 = 0"), k, scale=64.0, tile_rows=50).collect()
        assert Counter(map(tuple, got)) == wanted
    few = df.where("vec_id < 3").dropDuplicates(["vec_id"])
    assert topk.exact_top_k(few, few, 20, scale=64.0).count() == 6
    assert topk.exact_top_k(df.where("false"), df.where("false"), 20, scale=64.0).count() == 0


def test_nearest(spark):
    for df in (vectors_with_faults(spark), repeated_vectors(spark)):
        cosine = lambda a, b: float(neighbours.cosines(a[None], b[None])[0])
        wanted = plain_ranks(usable_rows(df, True), lambda i: i is not None and i % 50 == 0, 5, cosine)
        got = neighbours.nearest(df, df.where("vec_id % 50 = 0"), 5, tile_rows=50).collect()
        assert Counter(map(tuple, got)) == wanted
    assert neighbours.nearest(df.where("false"), df.where("false"), 5).count() == 0
    uneven = spark.createDataFrame([(0, [1.0]), (50, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="equal lengths"):
        neighbours.nearest(uneven, uneven, 5).collect()


# similar documents


def plain_components(sets, percent):
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("size", "percent", "frequent"), [(3, 90, 8), (3, 90, 2), (5, 80, 2)])
def test_jaccard_components_on_near_copies(spark, size, percent, frequent):
    rng = random.Random(size * percent + frequent)
    vocabulary = [f"w{i}" for i in range(4000)]
    bases = [[rng.choice(vocabulary) for _ in range(n)] for n in (8, 20, 40, 70, 130, 260)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = [None, "", "w1", "w1 w2"]
    for base in bases:
        for _ in range(40):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, max(1, len(own) // 40), len(own) // 12])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    for _ in range(60):
        texts.append(" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("node", F.lit(1)).repartition(6)
    got = {r.doc_id: r for r in jaccard.jaccard_components(df, size=size, percent=percent, frequent=frequent).collect()}
    sets = [set(shingle_set(t, size).tolist()) for t in texts]
    roots, lowest = plain_components(sets, percent), {}
    for i, r in enumerate(roots):
        lowest.setdefault(r, i)
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id) == (len(s), lowest[roots[i]]), i


def test_jaccard_edge_cases(spark, docs, none):
    assert jaccard.jaccard_components(docs).count() == docs.count()
    assert jaccard.jaccard_components(none).count() == 0


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    groups = {x: {x} for p in pairs for x in p}
    for a, b in pairs:
        union = groups[a] | groups[b]
        for x in union:
            groups[x] = union
    assert all(got[x] == min(groups[x]) for x in got) and all(x in got for a, b in pairs for x in (a, b) if a != b)


# quality


def test_quality_of_edge_cases(spark):
    texts = ["the cat sat on the mat, the cat!", "a dog and the cat sat", "über 3 cats"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(9, "the dog sat on 5 mats?", "en"), (10, None, None), (11, "", "de"), (12, " \n", "de")], "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(0,), (1,), (2,), (None,)], "doc_id long")
    got = {r.doc_id: r for r in quality.classify(df, trusted, calibration=0).collect()}
    assert not got[10].keep and not got[11].keep and not got[12].keep and got[0].keep
    assert quality.classify(df, trusted.where("false"), calibration=0).where("keep").count() == 4
    assert quality.classify(df.where("false"), trusted).count() == 0
    extra = {c: F.lit(1) for c in ("id", "salt", "block", "part", "rest", "row", "bits", "trusted", "keep", "n_words")}
    kept = quality.keep_good(df.withColumns(extra), trusted, calibration=0)
    assert kept.columns == df.withColumns(extra).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.keep)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 1000):
        for top in (1, 2, 255, 256, 1 << 20, (1 << 63) - 1):
            numbers = rng.integers(0, top, n)
            assert (quality.unpacked(quality.packed(numbers), n) == numbers).all()
            assert len(quality.packed(numbers)) <= n * max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)


def plain_word_costs(texts, probe):
    """Interpolated modified Kneser-Ney over words and the words before them."""
    runs = [[quality._FIRST, *quality.words_of(t).tolist()] for t in texts]
    pairs = Counter(p for r in runs for p in zip(r, r[1:]))
    before = Counter(w for _, w in pairs)
    few = [Counter(c.values()) for c in (pairs, before)]
    upper, lower = (quality.discounts(*[f[i] for i in (1, 2, 3, 4)]) for f in few)
    total, left = sum(before.values()), sum(lower[min(c, 3) - 1] for c in before.values())
    out, words = [], [quality._FIRST, *quality.words_of(probe).tolist()]
    for v, w in zip(words, words[1:]):
        p = ((before[w] - lower[min(before[w], 3) - 1]) if w in before else 0) / total + left / total / (len(before) + 1)
        own = {x: c for (u, x), c in pairs.items() if u == v}
        if own:
            cut = sum(upper[min(c, 3) - 1] for c in own.values())
            p = ((own[w] - upper[min(own[w], 3) - 1]) if w in own else 0) / sum(own.values()) + cut / sum(own.values()) * p
        out.append(-math.log2(p))
    return np.mean(out)


@pytest.mark.parametrize("rows", [1_000_000, 3])
def test_word_perplexity_equals_its_definition(spark, monkeypatch, rows):
    monkeypatch.setattr(quality, "BLOCK_CHARS", 40)  # several blocks
    monkeypatch.setattr(quality, "PART_ROWS", rows)  # one part, or many
    texts = ["the cat sat on the mat, the cat!", "a dog and the cat sat", "über 3 cats", "北京是中国的首都", "서울 한국"]
    probes = ["the dog sat on 5 mats?", "首都是北京", "京北国首", "the the the"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts + probes)] + [(20, None, "en")], "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(len(texts))], "doc_id long")
    got = {r.doc_id: r for r in quality.classify(df, trusted, calibration=0).collect()}
    for i, t in enumerate(texts + probes):
        assert math.isclose(got[i].bits, plain_word_costs(texts, t), rel_tol=1e-6), t
    assert got[20].bits is None and len({got[i].bits for i in (5, 6, 7)}) == 3
    # the model has a row per different pair and word, however many there are
    many = spark.range(20_000).selectExpr("concat('w', id, ' v', id) AS text")
    assert quality.train_words(many).rows.count() == 20_000 * 4 + 1


def test_squeezed_numbers_come_back_and_are_smaller():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 3000):
        for top in (1, 2, 255, 256, 1 << 20, (1 << 63) - 1):
            numbers = rng.integers(0, top, n)
            assert (quality.unsqueezed(quality.squeezed(numbers), n) == numbers).all()
    gaps = np.diff(np.sort(rng.integers(0, 1 << 44, 300_000)))[:3000]
    assert len(quality.squeezed(gaps)) < 0.95 * len(quality.packed(gaps))


def test_scores_do_not_depend_on_rounds_and_blocks(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    trusted = docs.where("doc_id % 2 = 0").select("doc_id")
    found = lambda: {r.doc_id: (r.n_words, r.bits, r.repetition, r.keep) for r in quality.classify(docs, trusted).collect()}
    once = found()
    monkeypatch.setattr(quality, "BLOCK_CHARS", 20_000)
    monkeypatch.setattr(quality, "ROUND_CHARS", 50_000)
    monkeypatch.setattr(quality, "HELD_ROWS", 500)
    monkeypatch.setattr(quality, "COST_WORDS", 100)
    again = found()
    assert once.keys() == again.keys() and len(once) > 50
    for i, (n, bits, lacking, keep) in once.items():
        assert (n, lacking, keep) == (again[i][0], again[i][2], again[i][3]) and (bits is None or math.isclose(bits, again[i][1], rel_tol=1e-9))


def test_stored_tables_release_what_was_shuffled(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return {x for x in files.split() if re.search(r"shuffle_\d+.*\.data$", x)}

    before = shuffled()
    stored = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("x")).count(), "test", release=True)
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before and stored.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_repetition():
    one = lambda words: quality.repetition(words, np.array([len(words)]))[0]
    words = np.array([1, 2, 3] * 30)
    assert one(words[:1]) == one(np.arange(50)) == one(words[:0]) == 0
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 6, n) for n in (2, 0, 9, 16, 1, 40, 0, 17)]
    got = quality.repetition(np.concatenate(texts), np.array([len(t) for t in texts]))
    for words, found in zip(texts, got):
        sizes = [np.bincount(words[i : i + 16]) for i in range(max(1, len(words) - 15))]
        assert math.isclose(found, max(math.log2((c**2).sum() / c.sum()) for c in sizes) if len(words) else 0, abs_tol=1e-12)


def test_quality_rejects_every_kind_of_junk(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    got = quality.classify(docs, quality.trusted_ids(labels.where(~held)))
    runs = docs.select("doc_id", F.col("text").rlike(r"(?i)(?:^|\W)(\w+)(?:\W+\1){9}(?:\W|$)").alias("run"))
    rows = got.join(labels.where(held), "doc_id").join(runs, "doc_id").select("quality", "toxic", "run", "keep").collect()
    kept = lambda *kind: np.mean([r.keep for r in rows if (r.quality, r.toxic, r.run) == kind])
    assert kept(0, 0, True) == kept(0, 1, True) == 0 and kept(0, 0, False) < 0.05 and kept(0, 1, False) < 0.05
    assert kept(1, 0, False) > 0.95


def test_quality_tells_junk_from_trusted_text(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    got = quality.classify(docs, quality.trusted_ids(labels.where(~held)))
    rows = got.join(labels.where(held), "doc_id").select("quality", "keep").collect()
    good, bad = ([r.keep for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.3
    kept = quality.keep_good(docs, quality.trusted_ids(labels))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.classify(docs, quality.trusted_ids(labels)).where("keep").collect()}


# pipeline


def test_pipeline_stages(spark, docs, none):
    table = docs.select("doc_id", "text", "lang", "source", "n_chars", "id", "spans", "removed")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, SF).columns == table.columns, name
        assert stage(spark, none.select(*table.columns), SF).count() == 0
    rows = [(i, f"text number {i} speaks of {'many things ' * 9}{i * 7919}", "en", "s", 1) for i in range(3)] + [(5, "text number 0 speaks of " + "many things " * 9 + "0", "en", "s", 1)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), SF)
    assert 5 not in {r.doc_id for r in kept.collect()}
    masked = corpus_pipeline.personal_data(spark, spark.createDataFrame([(1, "mail a@b.co", "en", "s", 1), (None, None, None, None, None)], DOCS), SF)
    assert {tuple(r) for r in masked.collect()} == {(1, "mail [EMAIL]", "en", "s", 12), (None, None, None, None, None)}


def test_pipeline_runs_whole(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_sets_are_made_of_few_texts_at_once():
    texts = [None if i % 50 == 0 else " ".join(f"w{(i * j) % 97}" for j in range(i % 40)) for i in range(3 * jaccard.SET_ROWS + 5)]
    batch = pa.RecordBatch.from_pydict({"id": range(len(texts)), "text": texts})
    columns = {"n": ("long", pa.int64(), len), "s": ("binary", pa.binary(), lambda s: s.tobytes())}
    got = list(jaccard._sets_of(iter([batch, batch.slice(0, 0)]), 3, columns))
    assert [b.num_rows for b in got] == [jaccard.SET_ROWS] * 3 + [5]
    sets = [shingle_set(t, 3) for t in texts]
    rows = [r for b in got for r in b.to_pylist()]
    assert rows == [{"id": i, "n": len(s), "s": s.tobytes()} for i, s in enumerate(sets)]
