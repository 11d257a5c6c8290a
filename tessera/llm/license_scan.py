"""License scans: ordered signature rules in DataFrame functions alone.

A text is folded to its words, one space apart. A rule is a regular expression
over that, behind keywords: only texts that hold one of its keywords (and its
second one, if it has that) meet the expression. Every match of a rule holds
them, so they hide nothing. A rule has a priority; of overlapping detections,
one that lies within another goes when it is shorter, or as long and of lower
priority (then of the later label). What remains gives the labels. The base
phrases are found by the same matcher and are never suppressed.

Everything about a text stays in its row: no shuffle, no join.

Defined cases: null text is empty; a text without words has no places, null
first and last word, empty label strings and score 0; other columns are kept,
those named like a result are replaced; ids may be null or repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, free_name, table

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str  # "|" between alternatives; every match, with a space on either side, holds one
    pattern: str  # over words one space apart
    priority: int  # 1 to 100; also the confidence in per cent
    also: str = ""  # every match holds this too


#: Licences: label -> (keyword, how texts name it, versions). {v} in a name takes a version's words.
LICENCES: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    "mit": (" mit |massachusetts institute", ("mit", "massachusetts institute of technology"), ()),
    "expat": ("expat", ("expat",), ()),
    "x11": (" x11 ", ("x11",), ()),
    "apache": ("apache", ("apache", "apache software"), ("1 0", "1 1", "2 0")),
    "gpl": ("general public", ("gnu general public", "general public"), ("1", "2", "3")),
    "lgpl": ("general public", ("gnu lesser general public", "lesser general public", "gnu library general public"), ("2", "2 1", "3")),
    "agpl": ("affero", ("gnu affero general public", "affero general public"), ("1", "3")),
    "bsd": ("bsd", ("bsd",), ()),
    "bsd-2-clause": ("bsd", ("bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd"), ()),
    "bsd-3-clause": ("bsd", ("bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd"), ()),
    "bsd-4-clause": ("bsd", ("bsd 4 clause", "4 clause bsd", "original bsd"), ()),
    "0bsd": ("bsd", ("zero clause bsd", "bsd zero clause", "0bsd"), ()),
    "isc": (" isc |internet systems", ("isc", "internet systems consortium"), ()),
    "mpl": ("mozilla", ("mozilla public",), ("1 0", "1 1", "2 0")),
    "epl": ("eclipse", ("eclipse public",), ("1 0", "2 0")),
    "cddl": ("common development", ("common development and distribution",), ("1 0", "1 1")),
    "cpl": ("common public", ("common public",), ("1 0",)),
    "eupl": ("european union", ("european union public",), ("1 1", "1 2")),
    "artistic": ("artistic", ("artistic", "perl artistic"), ("1 0", "2 0")),
    "boost": ("boost", ("boost software",), ("1 0",)),
    "zlib": ("zlib", ("zlib", "zlib libpng"), ()),
    "python": ("python software| psf ", ("python software foundation", "psf"), ("2",)),
    "postgresql": ("postgresql", ("postgresql",), ()),
    "openssl": ("openssl", ("openssl",), ()),
    "php": (" php ", ("php",), ("3 0", "3 01")),
    "ruby": (" ruby ", ("ruby",), ()),
    "unlicense": ("unlicense", ("unlicense",), ()),
    "wtfpl": ("you want to public", ("do what the fuck you want to public",), ("2",)),
    "ofl": ("open font", ("sil open font", "open font"), ("1 0", "1 1")),
    "odbl": ("open database", ("open database", "open data commons open database"), ("1 0",)),
    "ms-pl": ("microsoft", ("microsoft public",), ()),
    "ms-rl": ("microsoft", ("microsoft reciprocal",), ()),
    "gfdl": ("documentation", ("gnu free documentation", "free documentation"), ("1 1", "1 2", "1 3")),
    "bsl": ("business source", ("business source",), ("1 1",)),
    "sspl": ("server side", ("server side public",), ("1",)),
}
CC = {"by": "attribution", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv(?:ative)?s?", "by nc": "attribution non ?commercial", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: How a sentence grants a licence, {n} being its name; priority; what every such sentence holds.
GRANTS = (
    ("{n} (?:software )?licen[sc]e", 60, "licen"),
    ("(?:licensed|released|distributed|available|provided|published|dual licensed) under (?:the |an? )?(?:terms (?:and conditions )?of )?(?:the |an? )?{n}(?: (?:style|compatible))?(?: (?:public )?licen[sc]e)?", 80, " under "),
    ("(?:subject to|governed by|covered by|under) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{n} (?:public )?licen[sc]e", 75, "licen"),
    ("licen[sc]e (?:is )?(?:the )?{n}", 50, "licen"),
)
#: Sentences that belong to one licence's own text.
SENTENCES = (
    Rule("mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software", 95),
    Rule("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 95),
    Rule("apache-2.0", "apache", "(?:http |https )?(?:www )?apache org licenses license 2 0", 90),
    Rule("gpl", "free software", "this program is free software you can redistribute it and or modify it", 90),
    Rule("lgpl", "free software", "this library is free software you can redistribute it and or modify it", 90),
    Rule("gpl", "gnu org", "(?:http |https )?(?:www )?gnu org (?:licenses|copyleft) gpl(?: html| txt)?", 85),
    Rule("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", 90),
    Rule("zlib", "provided as is", "this software is provided as is without any express or implied warranty", 70),
    Rule("warranty-disclaimer", "without warrant", "without warrant(?:y|ies)(?: or conditions)? of any kind", 30),
    Rule("warranty-disclaimer", "provided as is", "provided as is(?: without warranty)?", 20),
    Rule("unlicense", "public domain", "this is free and unencumbered software released into the public domain", 95),
    Rule("public-domain", "public domain", "(?:released|placed|dedicated|is) (?:in|into|to) the public domain", 60),
    Rule("cc0-1.0", " cc0 ", "cc0(?: 1 0)?(?: universal)?", 80),
    Rule("proprietary", "all rights reserved", "all rights reserved", 25),
    Rule("copyright-notice", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", 25),
)


def rules() -> list[Rule]:
    """All rules but the base phrases; several hundred from the tables above."""
    out = list(SENTENCES)
    for label, (keyword, names, versions) in LICENCES.items():
        name = "(?:" + "|".join(names) + ")"
        for grant, priority, also in GRANTS:
            out.append(Rule(label, keyword, grant.format(n=name), priority, also))
        for v in versions:
            tag = f"{label}-{v.replace(' ', '.')}"
            tail = "(?: licen[sc]e)?(?: version| v)? " + v + "(?: or (?:any )?(?:later|newer)(?: version)?)?"
            out.append(Rule(tag, keyword, name + tail, 70))
            out.append(Rule(tag, keyword, GRANTS[1][0].format(n=name) + "(?: version| v)? " + v, 90, GRANTS[1][2]))
        # an identifier that stands alone: its version or clauses tell it from a word
        for tag in (*(f"{label} {v}" for v in versions), *([label] if label.endswith("clause") else ())):
            words = tag.replace("-", " ")
            out.append(Rule(tag.replace(" ", "-", 1).replace(" ", "."), f" {words.split()[0]} ", words, 55))
        ids = [label, *(f"{label} {v}" for v in versions)]
        for i in ids:
            out.append(Rule(i.replace(" ", "-", 1).replace(" ", "."), "spdx", "spdx licen[sc]e identifier " + i.replace("-", " ") + "(?: 0)?(?: only| or later)?", 100))
    for short, long in (("gpl", "gpl"), ("lgpl", "lgpl"), ("agpl", "agpl")):
        for v in ("", "1", "2", "2 1", "3"):
            out.append(Rule(f"{short}-{v.replace(' ', '.')}" if v else short, f" {short}", f"{long} ?v?(?:ersion )?{v}(?: 0)?" if v else long, 55 if v else 30))
    for code, words in CC.items():
        for v in CC_VERSIONS:
            out.append(Rule(f"cc-{code.replace(' ', '-')}-{v.replace(' ', '.')}", " cc ", f"cc {code} {v}", 85))
            out.append(Rule(f"cc-{code.replace(' ', '-')}-{v.replace(' ', '.')}", "creative commons", f"creative commons {words} {v}(?: international| unported)?", 85))
        out.append(Rule(f"cc-{code.replace(' ', '-')}", " cc ", f"cc {code}", 60))
        out.append(Rule(f"cc-{code.replace(' ', '-')}", "creative commons", f"creative commons {words}", 60))
    return out


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _places(norm: Column, pattern: Column) -> Column:
    """array<struct<start, words>> of the pattern's places in words one space apart, from word 0."""
    # a mark goes before each place's first word, so that the words' own numbers are the starts
    starts = F.filter(F.transform(F.split(F.trim(F.regexp_replace(norm, pattern, F.lit("\x01$0"))), " "), lambda w, i: F.when(F.startswith(w, F.lit("\x01")), i.cast("bigint"))), lambda i: i.isNotNull())
    return F.zip_with(starts, F.regexp_extract_all(norm, pattern, F.lit(0)), lambda i, m: F.struct(i.alias("start"), (_spaces(m) + 1).cast("bigint").alias("words")))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator, so that later expressions read them instead of holding copies of them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and detections."""
    own = [c for c in docs.columns if c not in (*RESULT, "detections")]
    lower, norm, raw, base, rank = (free_name([*own, *RESULT], f"_tess_{x}") for x in ("lower", "norm", "raw", "base", "rank"))
    whole = lambda p: f"(?<= )(?:{p})(?= )"
    groups: dict[tuple[str, str], list[Rule]] = {}
    for r in rules():
        groups.setdefault((r.keyword, r.also), []).append(r)
    table_ = F.array(*[F.struct(F.array(*map(F.lit, keyword.split("|"))).alias("keywords"), F.lit(also).alias("also"), F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(whole(r.pattern)).alias("pattern"), F.lit(r.priority).alias("priority")) for r in rs]).alias("rules")) for (keyword, also), rs in groups.items()])
    phrases = F.array(*[F.struct(F.lit(v).alias("label"), F.lit(whole(k)).alias("pattern")) for k, v in BASE.items()])
    text = _once(docs.select(*own), **{lower: ascii_lower(F.coalesce(F.col(text_col), F.lit("")))})
    # spaces of two kinds would hide a phrase: a text is folded to its words first
    text = _once(text, **{norm: F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, SEPARATOR, " ")), F.lit(" ")), "n_words": F.regexp_count(lower, F.lit(WORD)).cast("bigint")})
    place_t = "array<struct<start:bigint,words:bigint,label:string,priority:int>>"
    hits = F.flatten(
        F.transform(
            F.flatten(F.transform(F.filter(table_, lambda g: F.exists(g["keywords"], lambda k: F.contains(F.col(norm), k)) & F.contains(F.col(norm), g["also"])), lambda g: g["rules"])),
            lambda r: F.transform(_places(F.col(norm), r["pattern"]), lambda p: F.struct(p["start"].alias("start"), p["words"].alias("words"), r["label"].alias("label"), r["priority"].alias("priority"))),
        )
    )
    base_hits = F.flatten(F.transform(phrases, lambda r: F.transform(_places(F.col(norm), r["pattern"]), lambda p: F.struct(p["start"].alias("start"), p["words"].alias("words"), r["label"].alias("label"), F.lit(100).alias("priority")))))
    none = F.array().cast(place_t)
    found = _once(text, **{raw: hits.cast(place_t), base: F.when(F.contains(F.col(norm), F.lit("license")), base_hits.cast(place_t)).otherwise(none)})

    # in order of start, the longer and then the higher ranked first, what lies within another ends no later than one before it
    ranked = F.array_sort(F.array_distinct(F.transform(F.col(raw), lambda m: F.struct(m["start"].alias("start"), (-m["words"]).alias("shorter"), (-m["priority"]).alias("lower"), m["label"].alias("label")))))
    found = _once(found, **{rank: F.transform(ranked, lambda x: F.struct(x["start"].alias("start"), (-x["shorter"]).alias("words"), x["label"].alias("label"), (-x["lower"]).alias("priority")))})
    kept = _once(
        found,
        detections=F.aggregate(
            F.col(rank),
            F.struct(F.lit(-1).cast("bigint").alias("end"), F.array().cast(place_t).alias("out")),
            lambda a, m: F.when(m["start"] + m["words"] <= a["end"], a).otherwise(F.struct((m["start"] + m["words"]).alias("end"), F.concat(a["out"], F.array(m)).alias("out"))),
            lambda a: a["out"],
        ),
    )
    labels = lambda c: F.transform(c, lambda m: m["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    starts = F.transform(F.col(base), lambda m: m["start"])
    return kept.select(
        *own,
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(labels(F.col(base))).alias("base_labels"),
        joined(F.concat(labels(F.col(base)), labels(F.col("detections")))).alias("labels"),
        (F.lit(1.0) - F.aggregate(F.concat(F.col("detections"), F.col(base)), F.lit(1.0), lambda a, m: a * (F.lit(1.0) - m["priority"] / F.lit(101.0)))).alias("score"),
        "detections",
    )


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *RESULT)
