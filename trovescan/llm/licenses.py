"""License detection by ordered signature rules (operator 5). DataFrame functions only."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovescan.llm.registry import query, table

# The phrases that are always looked for, with their labels.
BASE = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]

# Label, keyword that must occur, expression for the name. Texts are lower-case words
# with one blank between them, so "2.0" reads "2 0".
NAMES = [
    ("apache-2.0", "apache", r"apache (?:software )?license(?: version)? v?2(?: 0)?"),
    ("apache-1.1", "apache", r"apache (?:software )?license(?: version)? v?1 1"),
    ("apache", "apache", r"apache (?:software )?license"),
    ("mit-0", "mit no", r"mit no attribution(?: license)?"),
    ("mit", "mit license", r"mit license"),
    ("x11", "x11 license", r"x11 license"),
    ("isc", "isc license", r"isc license"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|freebsd|bsd 2 clause)(?: license)?"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause)(?: license)?"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause)(?: license)?"),
    ("bsd", "bsd", r"bsd(?: style)? license"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license(?: version)? v?3(?: 0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public license"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public license(?: version)? v?2 1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public license(?: version)? v?3(?: 0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public license"),
    ("lgpl-2.0", "library general", r"(?:gnu )?library general public license(?: version)?(?: v?2(?: 0)?)?"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public license(?: version)? v?1(?: 0)?"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public license(?: version)? v?2(?: 0)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public license(?: version)? v?3(?: 0)?"),
    ("gpl", "general public", r"(?:gnu )?general public license"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl v?2(?: 0)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl v?3(?: 0)?"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation license(?: version)?(?: v?1 [0-3])?"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: version)? v?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license(?: version)? v?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public license"),
    ("epl-1.0", "eclipse", r"eclipse public license(?: version)? v?1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public license(?: version)? v?2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public license"),
    ("cddl", "development and distribution", r"common development and distribution license(?: version)?(?: 1 [01])?"),
    ("eupl", "european union", r"european union public license(?: version)?(?: v?1 [012])?"),
    ("artistic-1.0", "artistic", r"artistic license(?: version)? v?1(?: 0)?"),
    ("artistic-2.0", "artistic", r"artistic license(?: version)? v?2(?: 0)?"),
    ("artistic", "artistic", r"artistic license"),
    ("bsl-1.0", "boost", r"boost software license(?: version)?(?: 1 0)?"),
    ("zlib", "zlib", r"zlib(?: libpng)? license"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: license)?"),
    ("python", "python", r"python software foundation license(?: version)?(?: 2)?"),
    ("postgresql", "postgresql", r"postgresql license"),
    ("openssl", "openssl", r"openssl license"),
    ("ofl-1.1", "open font", r"(?:sil )?open font license(?: version)?(?: 1 1)?"),
    ("odbl", "open database", r"open database license(?: version)?(?: 1 0)?"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1-4] [0-9])?"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1-4] [0-9])?"),
    ("cc-by-nc", "cc by", r"cc by nc(?: [1-4] [0-9])?"),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1-4] [0-9])?"),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1-4] [0-9])?"),
    ("cc-by", "cc by", r"cc by(?: [1-4] [0-9])?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] [0-9])?(?: \w+)? license"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] [0-9])?(?: \w+)? license"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4] [0-9])?(?: \w+)? license"),
]

_LATER = "(?: only| or later)?"

# Label, keyword and expression of SPDX identifiers and short names. Many are words of their
# own, so they count in statements only.
SHORT = [
    ("apache-2.0", "apache", r"apache v?2(?: 0)?"),
    ("apache-1.1", "apache", r"apache v?1 1"),
    ("mit-0", "mit 0", r"mit 0"),
    ("mit", "mit", r"mit"),
    ("x11", "x11", r"x11"),
    ("isc", "isc", r"isc"),
    ("bsd", "bsd", r"bsd"),
    ("agpl-3.0", "agpl", rf"(?:gnu )?agpl v?3(?: 0)?{_LATER}"),
    ("agpl-3.0", "agplv3", rf"(?:gnu )?agplv3(?: 0)?{_LATER}"),
    ("agpl", "agpl", r"(?:gnu )?agpl"),
    ("lgpl-2.1", "lgpl", rf"(?:gnu )?lgpl v?2 1{_LATER}"),
    ("lgpl-2.1", "lgplv2 1", rf"(?:gnu )?lgplv2 1{_LATER}"),
    ("lgpl-2.0", "lgpl", rf"(?:gnu )?lgpl v?2(?: 0)?{_LATER}"),
    ("lgpl-2.0", "lgplv2", rf"(?:gnu )?lgplv2(?: 0)?{_LATER}"),
    ("lgpl-3.0", "lgpl", rf"(?:gnu )?lgpl v?3(?: 0)?{_LATER}"),
    ("lgpl-3.0", "lgplv3", rf"(?:gnu )?lgplv3(?: 0)?{_LATER}"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("gpl-1.0", "gpl", rf"(?:gnu )?gpl v?1(?: 0)?{_LATER}"),
    ("gpl-2.0", "gpl", rf"(?:gnu )?gpl v?2(?: 0)?{_LATER}"),
    ("gpl-2.0", "gplv2", rf"(?:gnu )?gplv2(?: 0)?{_LATER}"),
    ("gpl-3.0", "gpl", rf"(?:gnu )?gpl v?3(?: 0)?{_LATER}"),
    ("gpl-3.0", "gplv3", rf"(?:gnu )?gplv3(?: 0)?{_LATER}"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("gfdl", "gfdl", rf"(?:gnu )?gfdl(?: v?1 [0-3])?{_LATER}"),
    ("mpl-1.1", "mpl", r"mpl v?1 1"),
    ("mpl-2.0", "mpl", r"mpl v?2(?: 0)?"),
    ("mpl", "mpl", r"mpl"),
    ("epl-1.0", "epl", r"epl v?1(?: 0)?"),
    ("epl-2.0", "epl", r"epl v?2(?: 0)?"),
    ("epl", "epl", r"epl"),
    ("cddl", "cddl", r"cddl(?: v?1 [01])?"),
    ("eupl", "eupl", r"eupl(?: v?1 [012])?"),
    ("artistic-1.0", "artistic", r"artistic v?1(?: 0)?(?: perl| cl8)?"),
    ("artistic-2.0", "artistic", r"artistic v?2(?: 0)?"),
    ("bsl-1.0", "bsl", r"bsl v?1(?: 0)?"),
    ("bsl-1.0", "boost", r"boost(?: v?1 0)?"),
    ("zlib", "zlib", r"zlib"),
    ("python", "psf", r"psf(?: v?2(?: 0)?)?"),
    ("python", "python", r"python 2 0"),
    ("postgresql", "postgresql", r"postgresql"),
    ("openssl", "openssl", r"openssl"),
    ("ofl-1.1", "ofl", r"(?:sil )?ofl(?: v?1 1)?"),
    ("odbl", "odbl", r"odbl(?: v?1 0)?"),
]

# How a name is stated, most telling first; {} is the name.
STATEMENTS = [
    r"spdx license identifier {}",
    r"(?:is |are )?(?:dual )?licensed under (?:the )?(?:terms of )?(?:the )?{}",
    r"(?:is |are )?(?:released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?{}",
    r"under (?:the )?(?:terms|conditions|provisions) of (?:the )?{}",
    r"{} (?:applies|as published by)",
]

# Label, keyword, expression of sentences that stand for themselves.
SENTENCES = [
    ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms"),
    ("apache-2.0", "compliance with the license", r"you may not use this file except in compliance with the license"),
    ("gpl", "free software", r"this (?:program|library) is free software you can redistribute it and or modify it"),
    ("public-domain", "public domain", r"(?:released|dedicated|placed) (?:in|in to|into|to) the public domain"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?"),
    ("reserved", "rights reserved", r"all rights reserved"),
]


class Rule(NamedTuple):
    tier: int  # 1: statements and sentences, 2: bare names
    label: str
    keyword: str
    pattern: str


def build_rules() -> list[Rule]:
    """All rules in order of priority: each statement form with each name, long or short, sentences, then bare names."""
    rules = [Rule(1, label, key, form.format(f"(?:{name})")) for form in STATEMENTS for label, key, name in [*NAMES, *SHORT]]
    rules += [Rule(1, *sentence) for sentence in SENTENCES]
    return rules + [Rule(2, *name) for name in NAMES]


def words_text(text: Column) -> Column:
    """The text's words in lower case, with one blank before, between and after them; one blank if none.

    Lower-casing beyond A-Z changes no word boundary and none of the words looked for.
    """
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _phrase(column: str, n_words: Column, phrase: str) -> Column:
    """(n, first, last) of a phrase, by the pieces between its places; only where it occurs."""
    text = F.col(column)
    pieces = F.split(text, f" {phrase}(?= )", -1)
    found = F.transform(
        F.array(pieces),
        lambda p: F.struct(
            (F.size(p) - 1).cast("long").alias("n"),
            blanks(p[0]).cast("long").alias("first"),
            (n_words - (blanks(F.element_at(p, -1)) - 1) - len(phrase.split())).cast("long").alias("last"),
        ),
    )[0]
    return F.when(F.contains(text, F.lit(f" {phrase} ")), found)


def _found(column: str, rules: list[Rule]) -> Column:
    """All matches of the rules whose keyword occurs, as (start, -end, priority, tier, label) in words."""
    by_key: dict[str, list[tuple[int, Rule]]] = {}
    for i, rule in enumerate(rules):
        by_key.setdefault(rule.keyword, []).append((i, rule))
    text = F.col(column)

    def places(rule: Column) -> Column:
        pieces = F.split(text, rule["pattern"], -1)
        matches = F.regexp_extract_all(text, rule["pattern"], F.lit(0))

        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + blanks(pieces[i])
            end = start + blanks(matches[i])
            place = F.struct(
                start.alias("start"), (-end).alias("minus_end"), rule["nr"].alias("nr"), rule["tier"].alias("tier"),
                rule["label"].alias("label"),
            )
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(place)).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.lit([]).cast(f"array<{_PLACE}>").alias("out"))
        count = F.size(matches)
        return F.when(count > 0, F.aggregate(F.sequence(F.lit(0), count - 1), zero, step, lambda a: a["out"])).otherwise(
            F.lit([]).cast(f"array<{_PLACE}>")
        )

    gated = F.concat(
        *[
            F.when(
                F.contains(text, F.lit(f" {key} ")),
                F.array(
                    *[
                        F.struct(
                            F.lit(i).alias("nr"), F.lit(r.tier).alias("tier"), F.lit(r.label).alias("label"),
                            F.lit(f" {r.pattern}(?= )").alias("pattern"),
                        )
                        for i, r in own
                    ]
                ),
            ).otherwise(F.lit([]).cast("array<struct<nr:int,tier:int,label:string,pattern:string>>"))
            for key, own in by_key.items()
        ]
    )
    return F.when(F.size(gated) > 0, F.sort_array(F.flatten(F.transform(gated, places))))


_PLACE = "struct<start:int,minus_end:int,nr:int,tier:int,label:string>"


def _resolve(places: Column) -> Column:
    """Drop places inside an earlier one of the same or a better tier; equal places keep the first rule."""
    zero = F.struct(F.lit(-1).alias("one"), F.lit(-1).alias("two"), F.lit([]).cast(f"array<{_PLACE}>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        end = -p["minus_end"]
        inside = (acc["one"] >= end) | ((p["tier"] == 2) & (acc["two"] >= end))
        return F.struct(
            F.when(p["tier"] == 1, F.greatest(acc["one"], end)).otherwise(acc["one"]).alias("one"),
            F.when(p["tier"] == 2, F.greatest(acc["two"], end)).otherwise(acc["two"]).alias("two"),
            F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(p))).alias("out"),
        )

    return F.coalesce(F.aggregate(places, zero, step, lambda a: a["out"]), F.lit([]).cast(f"array<{_PLACE}>"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find license statements in every whole text; one pass over the rows, no shuffle.

    Texts become lower-case words. Some 500 rules run only on texts that hold their keyword; a place
    inside another of the same or a better tier gives way, the longer one and then the earlier rule
    staying. The base phrases are counted apart, by all their places.

    Returns ``id_col``, n_words, n_base, first_word, last_word, base_labels, detections (array of start,
    end, label, tier; in words from 0, end exclusive), labels (array, distinct, sorted) and score: the
    share of the words that lie in detections, 1 at most. Null and empty texts have no words, null first
    and last words, empty labels and score 0; ids may be null or repeat; an empty table gives no rows;
    other columns are not read.
    """
    rules = build_rules()
    base = docs.select(F.col(id_col), words_text(F.col(text_col)).alias("_text")).withColumn(
        "n_words", (blanks(F.col("_text")) - 1).cast("long")
    )
    phrases = base.withColumns({f"_p{i}": _phrase("_text", F.col("n_words"), p) for i, (p, _) in enumerate(BASE)})
    found = [F.col(f"_p{i}") for i in range(len(BASE))]
    base_labels = F.array_compact(F.array(*[F.when(p.isNotNull(), F.lit(label)) for p, (_, label) in zip(found, BASE, strict=True)]))
    return (
        phrases.withColumn("_kept", _resolve(_found("_text", rules)))
        .withColumn("_covered", F.aggregate("_kept", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), _cover, lambda a: a["n"]))
        .select(
            id_col,
            "n_words",
            sum((F.coalesce(p["n"], F.lit(0)) for p in found), F.lit(0)).cast("long").alias("n_base"),
            F.least(*[p["first"] for p in found]).alias("first_word"),
            F.greatest(*[p["last"] for p in found]).alias("last_word"),
            F.array_sort(base_labels).alias("base_labels"),
            F.transform(
                "_kept",
                lambda p: F.struct(p["start"].alias("start"), (-p["minus_end"]).alias("end"), p["label"].alias("label"), p["tier"].alias("tier")),
            ).alias("detections"),
            F.array_sort(F.array_union(base_labels, F.transform("_kept", lambda p: p["label"]))).alias("labels"),
            F.when(F.col("n_words") > 0, F.least(F.lit(1.0), F.col("_covered") / F.col("n_words"))).otherwise(0.0).alias("score"),
        )
    )


def _cover(acc: Column, p: Column) -> Column:
    end = -p["minus_end"]
    return F.struct(
        F.greatest(acc["end"], end).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], p["start"]))).alias("n"),
    )


@query()
def op5_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases and labels."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score", F.size("detections").cast("long").alias("n_detections"),
    )
