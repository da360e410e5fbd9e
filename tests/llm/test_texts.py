"""Decontamination, importance resampling and token alignment against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovescan.llm import alignment, byte_words, decontaminate, importance, repeats

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EXTRA = (
    "row", "key", "digest", "hits", "item_sets", "items", "n_words", "n_hit", "spans", "length", "window", "weight", "score",
    "rank", "n_features", "_row", "doc", "a", "b", "n_a", "groups", "pair", "n_links",
)


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def table_of(spark, rows, schema="doc_id long, text string"):
    """The rows over several partitions, with columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, schema).repartition(5)
    return df.withColumns({c: F.lit(1) for c in EXTRA})


def random_texts(seed, n, vocabulary=("a", "B", "c", "Ärger", "ΣΑΣ", "x1", "漢字", "é", "the")):
    rng = random.Random(seed)
    seps = [" ", ", ", "-", "\n", "_", "  "]
    return [
        "".join(w for _ in range(rng.randint(0, 60)) for w in (rng.choice(vocabulary), rng.choice(seps))) for _ in range(n)
    ]


@pytest.mark.parametrize("piece", [1, 3, 1 << 20])
def test_words_of_bytes(piece):
    for text in [*random_texts(1, 50), "", " ", "\x7f\x00", "ÀB", "no end", "x" * 5000]:
        own = [w for part in byte_words.word_lists(text.encode(), piece) for w in part]
        assert [w.decode() for w in own] == plain_words(text)
    assert list(byte_words.word_lists(None)) == []


# decontamination


def plain_hits(docs, items, window):
    """By row of ``docs``: words, words hit, maximal stretches, ids of items."""
    windows = defaultdict(set)
    for item, text in items:
        words = plain_words(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i : i + n])].add(item)
    out = []
    for doc, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if own := windows.get(tuple(words[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        spans = [(i, next(j for j in range(i, len(words) + 1) if j not in hit)) for i in sorted(hit) if i - 1 not in hit]
        out.append((doc, len(words), len(hit), spans, sorted(str(i) for i in found if i is not None)))
    return out


ITEMS = [
    (1, "Which of these, pray, is the one true and only name of the beast?"), (10, "short item"), (2, "the the the the the the the the the the the the"),
    (3, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (None, "an item without an id has words that hit but are not told at all"),
    (4, None), (5, ""), (6, "?!"), (7, "solo"), (8, "Short ITEM"), (1, "the second text of item one is here too and long enough"),
    (9, "which of these pray is the one true and only other name"), (11, "five words in this item"),
]


def hit_docs():
    rng = random.Random(3)
    words = [w for _, t in ITEMS for w in plain_words(t)]
    texts = [None, "", " ", "solo", "the " * 3000, " ".join(w for _, t in ITEMS for w in (t or "").split()), "one " * 40_000]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            own = plain_words(rng.choice(ITEMS)[1]) or ["x"]
            i = rng.randrange(len(own))
            parts += own[i : i + rng.randint(1, 14)] + [rng.choice(words) for _ in range(rng.randint(0, 5))]
        texts.append(rng.choice([" ", "--", ", "]).join(parts).upper())
    rows = list(enumerate(texts))
    return rows + [rows[-1], rows[-1], (None, texts[-2]), (None, None), (3, texts[-3])]


@pytest.mark.parametrize("window,gram,limit", [(10, 5, 2_000_000), (10, 5, 0), (10, 10, 2_000_000), (4, 3, 0), (1, 1, 2_000_000)])
def test_decontaminate_equals_plain(spark, window, gram, limit):
    docs = hit_docs()
    items = table_of(spark, ITEMS, "item_id long, text string")
    known = decontaminate.fingerprint(items, window=window, gram=gram)
    marked = decontaminate.decontaminate(table_of(spark, docs), known, keep=["doc_id", "row"], max_broadcast=limit).cache()
    got = decontaminate.with_items(marked, known, limit).collect()
    rows = [(r.doc_id, r.n_words, r.n_hit, [(s.start, s.end) for s in r.spans], r["items"]) for r in got]
    assert sorted(map(repr, rows)) == sorted(map(repr, plain_hits(docs, ITEMS, window)))
    assert set(got[0].asDict()) == {"doc_id", "row", "n_words", "n_hit", "spans", "items"}


def test_decontaminate_empty_tables(spark):
    docs, items = table_of(spark, hit_docs()[:9]), table_of(spark, ITEMS, "item_id long, text string")
    nothing = decontaminate.fingerprint(items.where("false"))
    for limit in (2_000_000, -1):
        marked = decontaminate.decontaminate(docs, nothing, max_broadcast=limit)
        assert [r.n_hit for r in marked.collect()] == [0] * 9
        assert all(r["items"] == [] for r in decontaminate.with_items(marked, nothing).collect())
        assert decontaminate.decontaminate(docs.where("false"), decontaminate.fingerprint(items), max_broadcast=limit).count() == 0
    with pytest.raises(ValueError):
        decontaminate.fingerprint(items, window=4, gram=5)


def test_winnowing_keeps_one_print_of_every_window():
    rng = np.random.default_rng(5)
    for _ in range(200):
        hashes = rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint64)
        width = int(rng.integers(1, 8))
        kept = set(decontaminate.chosen(hashes, width).tolist())
        for i in range(len(hashes) - width + 1):
            own = hashes[i : i + width]
            assert i + max(j for j in range(width) if own[j] == own.min()) in kept


def test_hits_are_not_shuffled_when_the_benchmark_is_small(spark):
    items = table_of(spark, ITEMS, "item_id long, text string")
    docs = spark.createDataFrame(hit_docs(), "doc_id long, text string")
    marked = decontaminate.decontaminate(docs, decontaminate.fingerprint(items))
    assert "Exchange" not in marked._jdf.queryExecution().executedPlan().toString()


# importance resampling


def plain_draw(docs, items, buckets, size, percent, min_words):
    def features(text):
        w = plain_words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, size + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(f for _, x in docs for f in features(x)), Counter(f for _, x in items for f in features(x))
    all_s, all_t = s.total() + buckets, t.total() + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(buckets)]
    rows = []
    for doc, text in docs:
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        own = features(text)
        weight = sum(gain[f] for f in own)
        rows.append((doc, len(plain_words(text)), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    drawn = able[: len(able) * percent // 100]
    rest = Counter(rows) - Counter(drawn)
    return Counter([(*r, i + 1) for i, r in enumerate(drawn)] + [(*r, None) for r in rest.elements()])


@pytest.mark.parametrize("size,percent,min_words", [(1, 10, 20), (3, 50, 0), (2, 100, 5), (1, 0, 0)])
def test_resampling_equals_plain(spark, size, percent, min_words):
    texts = random_texts(4, 120) + [None, "", "!", "a " * 50_000]
    docs = list(enumerate(texts)) + [(3, texts[3])] * 7 + [(None, texts[5]), (None, None), (4, texts[9])]
    items = list(enumerate(random_texts(6, 10, ("a", "漢字", "new"))))
    scored = importance.importance(
        table_of(spark, docs), table_of(spark, items), buckets=97, size=size, keep=["doc_id", "row"]
    )
    got = importance.draw(scored, percent, min_words)
    assert got.columns == ["doc_id", "row", "n_words", "n_features", "weight", "score", "rank"]
    rows = Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in got.collect())
    assert rows == plain_draw(docs, items, 97, size, percent, min_words)


def test_runs_over_piece_borders(monkeypatch):
    text = " ".join(f"w{i % 7}" for i in range(300)).encode()
    whole = sum(importance.feature_counts(text, 3), Counter())
    real = byte_words.word_lists
    monkeypatch.setattr(importance, "word_lists", lambda t: real(t, 5))
    assert sum(importance.feature_counts(text, 3), Counter()) == whole
    assert whole.total() == 300 + 299 + 298


def test_resampling_empty_tables(spark):
    docs, items = table_of(spark, [(1, "a b"), (2, None)]), table_of(spark, [(1, "a")])
    assert importance.draw(importance.importance(docs.where("false"), items)).count() == 0
    rows = importance.draw(importance.importance(docs, items.where("false")), 100, 0).collect()
    assert sorted(r["rank"] for r in rows) == [1, 2]


def test_lowest_drawn(spark):
    rng = random.Random(8)
    for scores in ([5], [rng.randint(-(10**12), 10**12) for _ in range(300)], [7] * 50 + [3] * 50, [-1, 0, 0, 0, 9]):
        df = spark.createDataFrame([(s,) for s in scores], "score long")
        for wanted in {1, len(scores) // 2 or 1, len(scores)}:
            assert importance.lowest_drawn(df, wanted, 16) == sorted(scores, reverse=True)[wanted - 1]


# token alignment


def plain_alignment(docs):
    left, right = alignment.default_left(), alignment.default_right()
    links, out = [], []
    for doc, text in docs:
        a = left.library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = right.library.encode(text) if text else []
        if any(b"".join(s.bytes_of[i] for i in ids) != f" {text}".encode() for s, ids in ((left, a), (right, b))):
            a, b = [], []
        x = y = at_a = at_b = 0
        own, groups, group = [], [], ([], [])
        while x < len(a) and y < len(b):
            own.append((a[x], b[y]))
            end_a, end_b = at_a + len(left.bytes_of[a[x]]), at_b + len(right.bytes_of[b[y]])
            if end_a <= end_b:
                group[0].append(str(a[x]))
                x, at_a = x + 1, end_a
            if end_b <= end_a:
                group[1].append(str(b[y]))
                y, at_b = y + 1, end_b
            if at_a == at_b:
                groups.append(group)
                group = ([], [])
        links.append(own)
        out.append((doc, len(a), len(b), len(groups), len(own), ";".join(",".join(p) + "|" + ",".join(q) for p, q in groups)))
    count = Counter(p for own in links for p in set(own))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return [
        (*o[:5], sum(count[p] == most[p[0]] for p in own), sum(count[p] for p in own), o[5])
        for o, own in zip(out, links, strict=True)
    ]


def token_docs():
    rng = random.Random(11)
    marks = ["the", " ", "  ", "\n", "漢字", "😀", "é", "é", "don't", "<|endoftext|>", "<s>", "▁", "\x00", "\t", "1234", "ß", "İ", "ﬁ", " ", " ", "Straße", "ñ"]
    texts = [None, "", " ", "a", "  two  blanks ", "<|endoftext|>", "▁", "�", "x" * 3000, "word and " * 4000]
    texts += ["".join(rng.choice(marks) for _ in range(rng.randint(1, 80))) for _ in range(150)]
    texts += ["".join(rng.choice(["the ", "tion", "wh", "漢", "é", " "]) for _ in range(900)) for _ in range(5)]
    rows = list(enumerate(texts))
    return rows + [rows[-1], rows[-1], (None, "null id"), (5, "another text")]


@pytest.mark.parametrize("piece,common", [(16_384, 1_000_000), (100, 1_000_000), (64, 50), (7, 1)])
def test_alignment_equals_plain(spark, piece, common):
    docs = token_docs()
    got = alignment.align(table_of(spark, docs).drop("n_a", "groups"), piece=piece, common=common)
    rows = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, plain_alignment(docs)))


def test_alignment_of_nothing(spark):
    docs = table_of(spark, [(1, None), (2, "")])
    assert alignment.align(docs.where("false")).count() == 0
    for r in alignment.align(docs, digest=True).collect():
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) == (0, 0, 0, 0, 0, 0, "")


def test_fast_way_gives_the_same_ids():
    left = alignment.default_left()
    rng = random.Random(2)
    marks = [*"aZ09 .,'\"-_\n\t\r!?()", "é", "ñ", "漢", "か", "ア", "한", "Я", "'s", "'ll", "  ", "¿", "ſ", "ĸ"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(1, 200))) for _ in range(1500)]
    assert not any(left._OTHER.search(t) for t in texts)
    assert left(texts) == [left.library.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_split_point_is_a_prefix_of_the_merge():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 40, rng.integers(0, 25))) for _ in range(2))
        before = (0, 0)
        for d in range(len(a) + len(b) + 1):
            i, j = alignment.split_point(a, b, d)
            assert i >= before[0] and j >= before[1] and i + j in (d, d + 1)
            taken, left = set(a[:i]) | set(b[:j]), set(a[i:]) | set(b[j:])
            assert not taken or not left or max(taken) < min(left)
            before = (i, j)


def test_alignment_query(spark):
    from trovescan.llm.catalog import QUERIES

    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = {r[0]: (*r[1:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in plain_alignment(docs)}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_align_tokens"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want


# repeated passages

CLAUSE = re.compile(r"[^.!?,;:\n]+")


def plain_passages(docs, min_words):
    """What stays of each row, and what is cut."""
    units = {}
    for doc, text in docs:
        own = [(m.start(), m.end(), tuple(plain_words(m[0]))) for m in CLAUSE.finditer(text or "")]
        units[doc, text] = [u for u in own if u[2]]
    rank = lambda d: (d[0] is not None, d[0] or 0)
    first = {}
    for key in sorted(units, key=rank):
        for i, u in enumerate(units[key]):
            place = (rank(key), i, key[1])
            if u[2] not in first or place[:2] < first[u[2]][:2]:
                first[u[2]] = place
    out = []
    for doc, text in docs:
        cuts, run = [], []
        for i, u in enumerate([*units[doc, text], None]):
            if u is not None and first[u[2]] != (rank((doc,)), i, text):
                run.append(u)
            else:
                if sum(len(x[2]) for x in run) >= min_words:
                    cuts.append((run[0][0], run[-1][1]))
                run = []
        kept = "".join((text or "")[i:j] for i, j in zip([0, *[c[1] for c in cuts]], [*[c[0] for c in cuts], len(text or "")]))
        out.append((doc, None if text is None else kept, cuts))
    return out


def passage_docs():
    rng = random.Random(21)
    words = ["alpha", "Beta", "γάμμα", "漢字", "d4", "été"]
    clause = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))
    passages = ["".join(clause() + rng.choice([", ", ". ", "\n", "; ", "?! ", " - "]) for _ in range(rng.randint(2, 8))) for _ in range(6)]
    texts = [None, "", ",.", "one two", "𝒳 " + passages[0], passages[0].upper() + "!", "a, b. " * 6000]
    for _ in range(60):
        texts.append("".join(rng.choice([clause() + ". ", rng.choice(passages)]) for _ in range(rng.randint(1, 6))))
    rows = list(enumerate(texts))
    return rows + [rows[-1], rows[-1], (None, texts[-2]), (None, None)]


@pytest.mark.parametrize("min_words,limit", [(12, 4_000_000), (12, 0), (1, 4_000_000), (500, 0)])
def test_passages_equal_plain(spark, min_words, limit):
    docs = passage_docs()
    df = table_of(spark, docs).withColumns({c: F.lit(1) for c in ("removed", "start", "number", "id", "version", "cuts")})
    got = repeats.remove_passages(df, min_words=min_words, max_broadcast=limit, hot_units=1_000 if limit else 3)
    assert got.columns == [*[c for c in df.columns if c != "removed"], "removed"]
    rows = [(r.doc_id, r.text, [(c.start, c.end) for c in r.removed]) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, plain_passages(docs, min_words)))
    assert repeats.remove_passages(df.where("false"), max_broadcast=limit).count() == 0


def test_passages_are_cut_in_given_documents(spark):
    from trovescan.llm.catalog import QUERIES

    rows = QUERIES["op8_remove_repeats"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r.n_removed > 0 for r in rows) > 30
