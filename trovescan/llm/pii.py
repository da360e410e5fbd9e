"""Personal data by base expressions and bootstrapped contexts (operator 4). DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trovescan.functions.vectors import bind
from trovescan.llm.registry import query, table
from trovescan.session import materialize

KINDS = ("email", "ip", "card", "phone")

#: Rounds of scoring between patterns and instances.
ROUNDS = 3
#: A pattern that discovers has this confidence, and so many different seeds.
CONFIDENCE = 0.9
SUPPORT = 3
#: A value may be of a kind if this share of the kind's seeds has its shape.
SHAPE_SHARE = 0.05

# Each expression finds what its base form finds, leftmost and greedy, but never starts inside a run
# whose start failed (unless the last match ended there), and gives back no characters in vain: so a
# long run of letters or digits takes linear time.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates: forms of addresses, groups of digits, other words that hold a digit or an at sign.
_CANDIDATES = "|".join(
    [
        rf"(?<![{_LOCAL}])[{_LOCAL}]++(?:@|\(at\)|\[at\])[A-Za-z0-9._-]++",
        r"(?<![A-Za-z0-9.@_%+-])[+(]{0,2}[0-9](?:[().\x20/-]{0,2}[0-9])*+(?![A-Za-z0-9@_%])",
        r"(?<![A-Za-z0-9@._%+-])(?=[A-Za-z._%+-]*+[0-9@])[A-Za-z0-9@._%+-]++",
    ]
)
_SPAN = "struct<start:int,end:int,value:string,before:string,after:string>"
#: A text is cut into stretches of so many characters when spans are replaced in it.
_STRETCH = 1000


def _none() -> Column:
    return F.lit([]).cast(f"array<{_SPAN}>")


def running(values: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """What ``add`` makes of all earlier elements of an array, for each of them.

    The array is cut into as many blocks as a block has elements, so n elements take n * sqrt(n) steps and no
    growing array is copied.
    """

    def over(v: Column) -> Column:
        n = F.size(v)

        def cut(width: Column) -> Column:
            blocks = F.transform(
                F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1), lambda b: F.slice(v, b * width + 1, width)
            )
            return bind(blocks, lambda held: bind(F.transform(held, lambda x: F.aggregate(x, zero, add)), lambda sums: within(held, sums)))

        def within(held: Column, sums: Column) -> Column:
            def block(x: Column, b: Column) -> Column:
                head = F.aggregate(F.slice(sums, F.lit(1), b), zero, add)
                return bind(head, lambda h: F.transform(x, lambda _, j: add(h, F.aggregate(F.slice(x, F.lit(1), j), zero, add))))

            return F.flatten(F.transform(held, block))

        width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
        return F.when(n > 0, bind(width, cut)).otherwise(F.slice(v, F.lit(1), F.lit(0)))

    return bind(values, over)


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"\s+", " ")


def _tail(piece: Column) -> Column:
    """The last two words of a plain piece, or all of it if it has fewer."""
    last = F.substring_index(F.rtrim(piece), " ", -2)
    return F.when(F.length(last) < F.length(F.rtrim(piece)), F.concat(F.lit(" "), last, F.when(piece.endswith(" "), " ").otherwise(""))).otherwise(piece)


def _head(piece: Column) -> Column:
    """The first word of a plain piece with the blank behind it, or all of it if it has fewer."""
    first = F.substring_index(F.ltrim(piece), " ", 1)
    return F.when(F.length(first) < F.length(F.ltrim(piece)), F.concat(F.when(piece.startswith(" "), " ").otherwise(""), first, F.lit(" "))).otherwise(piece)


def _spans(text: Column, pattern: str, keep=None) -> Column:
    """Every match as (start, end, value, before, after), in code points, by the pieces between the matches.

    ``before`` is the two words before the match and ``after`` the word behind it, in lower case, taken from the
    text itself: other matches count as words.
    """
    found = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))

    def walk(f: Column) -> Column:
        sizes = F.transform(f["values"], lambda v, i: F.length(f["pieces"][i]) + F.length(v))
        heads = F.transform(f["pieces"], lambda p: _head(_plain(p)))
        tails = F.transform(f["pieces"], lambda p: _tail(_plain(p)))
        parts = F.struct(
            running(sizes, F.lit(0), lambda x, y: x + y).alias("at"), heads.alias("heads"), tails.alias("tails"),
            F.transform(f["values"], _plain).alias("plain"),
        )
        return bind(parts, lambda p: F.transform(f["values"], lambda v, i: span(f, p, v, i)))

    def span(f: Column, p: Column, value: Column, i: Column) -> Column:
        start = p["at"][i] + F.length(f["pieces"][i])
        or_none = lambda c: F.coalesce(c, F.lit(""))
        left = F.concat(
            *[x for j in (2, 1) for x in (or_none(F.get(p["tails"], i - j)), or_none(F.get(p["plain"], i - j)))], p["tails"][i]
        )
        right = F.concat(*[x for j in (1, 2) for x in (or_none(F.get(p["heads"], i + j)), or_none(F.get(p["plain"], i + j)))])
        return F.struct(
            start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"),
            F.substring_index(F.trim(left), " ", -2).alias("before"), F.substring_index(F.trim(right), " ", 1).alias("after"),
        )

    spans = F.when(text.rlike(pattern), bind(found, walk)).otherwise(_none())
    return spans if keep is None else F.filter(spans, lambda s: keep(s["value"]))


def _ip(value: Column) -> Column:
    def small(part: Column) -> Column:
        digits = F.ltrim(part, F.lit("0"))
        return (F.length(digits) <= 3) & (F.coalesce(digits.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(value, r"\.", -1), small)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def weighed(i: Column) -> Column:
        d = F.substring(digits, -(i + 1), F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + weighed(i))
    return total % 10 == 0


def _card(value: Column) -> Column:
    digits = _digits(value)
    return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)


def _phone(value: Column) -> Column:
    return F.length(_digits(value)).between(8, 15)


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind, as arrays of (start, end, value, before), in order."""
    checks = {"email": None, "ip": _ip, "card": _card, "phone": _phone}
    gates = {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9][\x20-]?[0-9]"),
        "phone": F.contains(text, F.lit("+")),
    }
    return {k: F.when(gates[k], _spans(text, PATTERNS[k], checks[k])).otherwise(_none()) for k in KINDS}


def _patterns(before: Column, after: Column) -> Column:
    """The lexical patterns of an occurrence: the two words before it; the word before and the word behind it."""
    known = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    last = F.substring_index(before, " ", -1)
    return F.array(F.concat(known(before), F.lit(" _")), F.concat(known(last), F.lit(" _ "), known(after)))


def _shape(value: Column) -> Column:
    """What a value looks like, coarsely: scored apart from the patterns."""
    digits = F.length(_digits(value))
    return (
        F.when(value.rlike(r"@|\(at\)|\[at\]"), "at")
        .when(value.rlike(r"^[0-9]+(\.[0-9]+)+$"), "dots")
        .when(value.rlike("[A-Za-z_%]"), "word")
        .when(digits >= 6, "digits")
        .otherwise("few digits")
    )


def _discoveries(pairs: DataFrame, rounds: int, confidence: float, support: int) -> DataFrame:
    """(pattern, kind): the patterns trusted to discover.

    ``pairs`` has a row for each value and pattern that occur together, and the value's kind if it is a seed. They are the
    edges of a graph. A pattern's confidence in a kind is the mean score of its values; a value that is no
    seed has the confidence of its best pattern, if its shape is one that the kind's seeds have. Both are sums and maxima per
    key, so a common pattern or value is never gathered.
    """
    seeds = pairs.where("kind is not null").groupBy("value").agg(F.max("kind").alias("kind"), F.first("shape").alias("shape"))
    seeds = materialize(seeds, "seeds")
    shapes = _seed_shapes(seeds)
    scores = seeds.select("value", "kind", F.lit(1.0).alias("score"))
    sizes = pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("values"))
    for _ in range(rounds):
        weighed = pairs.select("value", "pattern").join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("score"))
        trust = materialize(
            weighed.join(sizes, "pattern").select("pattern", "kind", (F.col("score") / F.col("values")).alias("trust")), "trust"
        )
        guessed = (
            pairs.where("kind is null").select("value", "shape", "pattern").join(trust, "pattern")
            .join(F.broadcast(shapes), ["kind", "shape"])
            .groupBy("value", F.col("kind").alias("guess")).agg(F.max("trust").alias("score"))
            .join(seeds.select("value"), "value", "left_anti")
            .select("value", F.col("guess").alias("kind"), "score")
        )
        scores = seeds.select("value", "kind", F.lit(1.0).alias("score")).union(guessed)
    seeded = pairs.where("kind is not null").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds"))
    best = trust.join(seeded, ["pattern", "kind"]).where((F.col("trust") >= confidence) & (F.col("seeds") >= support))
    return best.groupBy("pattern").agg(F.max_by("kind", F.struct("trust", "kind")).alias("kind"))


def _seed_shapes(seeds: DataFrame) -> DataFrame:
    """(kind, shape): the shapes that at least ``SHAPE_SHARE`` of a kind's seeds have. A few rows for each kind."""
    counts = seeds.groupBy("kind", "shape").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("kind"))  # at most one row for each shape
    return counts.withColumn("share", share).where(F.col("share") >= SHAPE_SHARE).select("kind", "shape")


def find_personal_data(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = ROUNDS,
    confidence: float = CONFIDENCE,
    support: int = SUPPORT,
) -> DataFrame:
    """Find e-mail addresses, network addresses, card and phone numbers in every whole text.

    Base expressions find seeds in one pass; the same pass notes candidates: groups of digits with blanks and brackets,
    forms of addresses, and other words with a digit or an at sign, unless they overlap a seed. Seeds induce
    lexical patterns: the two words before, and the words on both sides. Patterns and values are scored against
    each other for ``rounds`` rounds; patterns of high confidence give their kind to the other values that they
    surround, if those have a shape that the kind's seeds have. Only these narrow rows are shuffled, texts are not.

    Returns ``id_col``, version (digest of the text) and spans: array of (kind, start, end, found),
    kinds as listed, then by start, in code points, end exclusive; found is "base" or "pattern". Null and
    empty texts have no spans; rows keep their number, those that share an id and a text have the same
    spans; ids may be null; a text of any length is read whole, and its matches are placed in n * sqrt(n) steps; an empty
    table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), text.alias("_text"))
    first = first.withColumns(base_spans(F.col("_text")))
    others = F.when(F.col("_text").rlike("[0-9@]|[(\\[]at[)\\]]"), _spans(F.col("_text"), _CANDIDATES)).otherwise(_none())
    rows = materialize(first.withColumn("other", others).select("id", "version", *KINDS, "other"), "found")

    def marked(kind: str) -> Column:
        name = F.lit(kind if kind in KINDS else None).cast("string")
        value = (lambda s: s["value"]) if kind in KINDS else (lambda s: F.rtrim(s["value"], F.lit("._%+-")))
        return F.transform(
            kind,
            lambda s: F.struct(
                s["start"].alias("start"), (s["start"] + F.length(value(s))).alias("end"), value(s).alias("value"),
                _patterns(s["before"], s["after"]).alias("patterns"), name.alias("kind"),
            ),
        )

    once = rows.dropDuplicates(["id", "version"])  # a text that fills the table is looked at once
    spans = F.explode(F.concat(*[marked(k) for k in (*KINDS, "other")])).alias("o")
    every = once.select("id", "version", spans).select("id", "version", "o.*")
    # The spans of one text, once forwards and once backwards: frames that begin anew at every row would take n * n steps.
    own, whole = Window.partitionBy("id", "version"), (Window.unboundedPreceding, 0)
    ahead, back = own.orderBy("start", F.col("kind").isNull()), own.orderBy(F.desc("start"), F.col("kind").isNotNull())
    earlier = F.max(F.when(F.col("kind").isNotNull(), F.col("end"))).over(ahead.rowsBetween(*whole))
    later = F.min(F.when(F.col("kind").isNotNull(), F.col("start"))).over(back.rowsBetween(*whole))
    free = (F.coalesce(earlier, F.lit(0)) <= F.col("start")) & (F.coalesce(later, F.col("end")) >= F.col("end"))
    every = every.withColumn("free", free).where("kind is not null or free").drop("free")
    every = materialize(every.withColumn("shape", _shape(F.col("value"))), "occurrences")
    pairs = every.select("value", "shape", "kind", F.explode("patterns").alias("pattern"))
    pairs = pairs.groupBy("value", "pattern").agg(F.max("kind").alias("kind"), F.first("shape").alias("shape"))
    pairs = materialize(pairs, "pairs")
    good = materialize(_discoveries(pairs, rounds, confidence, support), "patterns")
    shapes = _seed_shapes(pairs.where("kind is not null").groupBy("value").agg(F.max("kind").alias("kind"), F.first("shape").alias("shape")))
    more = (
        every.where("kind is null").drop("kind").withColumn("pattern", F.explode("patterns")).join(good, "pattern")
        .join(F.broadcast(shapes), ["kind", "shape"])
        .groupBy("id", "version")
        .agg(F.collect_set(F.struct(_order(F.col("kind")).alias("order"), "kind", "start", "end")).alias("more"))
        .select(F.col("id").alias("_id"), F.col("version").alias("_version"), "more")
    )

    def plain(kind: str) -> Column:
        return F.transform(
            kind,
            lambda s: F.struct(F.lit(KINDS.index(kind)).alias("order"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lit("base").alias("found")),
        )

    added = F.transform(
        F.coalesce("more", F.lit([]).cast("array<struct<order:int,kind:string,start:int,end:int>>")),
        lambda s: F.struct(s["order"].alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit("pattern").alias("found")),
    )
    spans = F.sort_array(F.concat(*[plain(k) for k in KINDS], added))
    joined = rows.join(more, F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")), "left")
    return joined.select(
        F.col("id").alias(id_col), "version",
        F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"))).alias("spans"),
    )


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int") - 1


def mask(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first one's.

    The text is cut into short stretches once, so the time is linear in it, whatever the number of spans. A null text
    stays null, and one without spans as it is.
    """
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), s["kind"].alias("kind")))
    )
    later = lambda a, b: F.greatest(a, b)

    def part(held: Column, low: Column, high: Column) -> Column:
        first, last = F.floor(low / _STRETCH).cast("int"), F.floor(high / _STRETCH).cast("int")
        begin = F.substring(F.get(held, first), low % _STRETCH + 1, F.lit(_STRETCH))
        middle = F.array_join(F.slice(held, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        end = F.coalesce(F.substring(F.get(held, last), F.lit(1), high % _STRETCH), F.lit(""))
        inside = F.substring(F.get(held, first), low % _STRETCH + 1, high - low)
        return F.when(high <= low, "").when(first == last, inside).otherwise(F.concat(F.coalesce(begin, F.lit("")), middle, end))

    def put(held: Column, o: Column, upto: Column) -> Column:
        heads = F.filter(
            F.transform(o, lambda s, i: F.struct(upto[i].alias("from"), s["start"].alias("start"), s["kind"].alias("kind"))),
            lambda h: h["start"] >= h["from"],
        )
        marks = F.transform(heads, lambda h: F.concat(part(held, h["from"], h["start"]), F.lit("["), F.upper(h["kind"]), F.lit("]")))
        end = F.array_max(F.transform(o, lambda s: -s["minus_end"]))
        return F.concat(F.array_join(marks, ""), part(held, end, F.length(text)))

    stretches = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_STRETCH}}}"), F.lit(0))
    replaced = bind(stretches, lambda held: bind(ordered, lambda o: bind(
        running(F.transform(o, lambda s: -s["minus_end"]), F.lit(0), later), lambda upto: put(held, o, upto)
    )))
    return F.when(F.size(spans) > 0, replaced).otherwise(text)


def _is(kind: str):
    return lambda span: span["kind"] == kind


@query()
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: counts and digest of the base spans, and all spans."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["found"] == "base")
    told = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return found.select(
        "doc_id",
        *[F.size(F.filter(base, _is(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(told(base), 256).alias("base_sha256"),
        told("spans").alias("spans"),
    )
