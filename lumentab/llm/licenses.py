"""License scan: ordered signature rules behind a keyword prefilter.

Texts are folded to words joined by blanks.  Each rule is a regular expression
over those words with a keyword, a priority and a label; a text meets only the
rules whose keyword it holds.  Overlapping detections are resolved by priority
and interval containment.  Only DataFrame functions are used.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentab.llm.common import NOT_WORD, computed_once, lower_ascii

# fixed values: phrases and labels that are always reported
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: label, keyword, name of the license as a pattern over words, short name, words of its address
FAMILIES = (
    ("mit", "mit", "mit(?: expat| x11)? licen[sc]e", "mit", "opensource org licenses mit"),
    ("apache-2", "apache|apache2|apachev2", "apache(?: software)? licen[sc]e(?: version| v)? v?2(?: 0)?", "apache(?: version| v)? ?v?2(?: 0)?", "apache org licenses license 2 0"),
    ("apache-1", "apache|apache1|apachev1", "apache(?: software)? licen[sc]e(?: version| v)? v?1(?: [01])?", "apache(?: version| v)? ?v?1(?: [01])?", "apache org licenses license 1 1"),
    ("gpl-2", "gnu|gpl|gpl2|gplv2", "gnu general public licen[sc]e(?: version| v)? v?2(?: 0)?", "(?:gnu )?gpl(?: version| v)? ?v?2(?: 0)?", "gnu org licenses(?: old licenses)? gpl 2 0"),
    ("gpl-3", "gnu|gpl|gpl3|gplv3", "gnu general public licen[sc]e(?: version| v)? v?3(?: 0)?", "(?:gnu )?gpl(?: version| v)? ?v?3(?: 0)?", "gnu org licenses gpl 3 0"),
    ("lgpl-2", "gnu|lgpl|lgpl2|lgplv2", "gnu (?:lesser|library) general public licen[sc]e(?: version| v)? v?2(?: [01])?", "(?:gnu )?lgpl(?: version| v)? ?v?2(?: [01])?", "gnu org licenses(?: old licenses)? lgpl 2 [01]"),
    ("lgpl-3", "gnu|lgpl|lgpl3|lgplv3", "gnu lesser general public licen[sc]e(?: version| v)? v?3(?: 0)?", "(?:gnu )?lgpl(?: version| v)? ?v?3(?: 0)?", "gnu org licenses lgpl 3 0"),
    ("agpl-3", "affero|agpl|agpl3|agplv3", "gnu affero general public licen[sc]e(?: version| v)? v?3(?: 0)?", "(?:gnu )?agpl(?: version| v)? ?v?3(?: 0)?", "gnu org licenses agpl 3 0"),
    ("gfdl", "gnu|gfdl", "gnu free documentation licen[sc]e(?: version 1 [123])?", "gfdl(?: 1 [123])?", "gnu org licenses fdl(?: 1 [123])?"),
    ("bsd-2", "bsd|freebsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd) licen[sc]e", "(?:bsd 2 clause|2 clause bsd)", "opensource org licenses bsd 2 clause"),
    ("bsd-3", "bsd", "(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd|revised bsd) licen[sc]e", "(?:bsd 3 clause|3 clause bsd)", "opensource org licenses bsd 3 clause"),
    ("bsd-4", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd) licen[sc]e", "(?:bsd 4 clause|4 clause bsd)", "spdx org licenses bsd 4 clause"),
    ("isc", "isc", "isc licen[sc]e", "isc", "opensource org licenses isc"),
    ("mpl-1", "mozilla|mpl|mpl1|mplv1", "mozilla public licen[sc]e(?: version| v)? v?1(?: [01])?", "mpl(?: version| v)? ?v?1(?: [01])?", "mozilla org mpl 1 [01]"),
    ("mpl-2", "mozilla|mpl|mpl2|mplv2", "mozilla public licen[sc]e(?: version| v)? v?2(?: 0)?", "mpl(?: version| v)? ?v?2(?: 0)?", "mozilla org(?: en us)? mpl 2 0"),
    ("epl-1", "eclipse|epl|epl1|eplv1", "eclipse public licen[sc]e(?: version| v)? v?1(?: 0)?", "epl(?: version| v)? ?v?1(?: 0)?", "eclipse org legal epl v10"),
    ("epl-2", "eclipse|epl|epl2|eplv2", "eclipse public licen[sc]e(?: version| v)? v?2(?: 0)?", "epl(?: version| v)? ?v?2(?: 0)?", "eclipse org legal epl 2 0"),
    ("cddl", "cddl|distribution", "common development and distribution licen[sc]e", "cddl(?: 1 [01])?", "opensource org licenses cddl"),
    ("boost", "boost|bsl", "boost software licen[sc]e", "bsl 1(?: 0)?", "boost org license 1 0"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e", "zlib", "opensource org licenses zlib"),
    ("unlicense", "unlicense", "the unlicense", "unlicense", "unlicense org"),
    ("wtfpl", "wtfpl|fuck", "do what the fuck you want to public licen[sc]e", "wtfpl", "wtfpl net"),
    ("artistic", "artistic", "artistic licen[sc]e(?: 2(?: 0)?)?", "artistic 2(?: 0)?", "opensource org licenses artistic"),
    ("python", "python|psf", "python software foundation licen[sc]e", "psf 2(?: 0)?", "docs python org license"),
    ("postgresql", "postgresql", "postgresql licen[sc]e", "postgresql", "opensource org licenses postgresql"),
    ("openssl", "openssl", "openssl licen[sc]e", "openssl", "openssl org source license"),
    ("ofl", "sil|ofl", "sil open font licen[sc]e", "ofl 1 1", "scripts sil org ofl"),
    ("eupl", "eupl|european", "european union public licen[sc]e", "eupl 1 [12]", "joinup ec europa eu eupl"),
    ("ms-pl", "microsoft|ms", "microsoft public licen[sc]e", "ms pl", "opensource org licenses ms pl"),
    ("ms-rl", "microsoft|ms", "microsoft reciprocal licen[sc]e", "ms rl", "opensource org licenses ms rl"),
    ("cc0", "cc0|zero", "creative commons zero", "cc0(?: 1 0)?", "creativecommons org publicdomain zero"),
    ("cc-by", "cc|attribution|creativecommons", "(?:creative commons|cc) attribution(?: [234] [05])?(?: international)? licen[sc]e", "cc by(?= [1-4] )", "creativecommons org licenses by(?= [1-4] )"),
    ("cc-by-sa", "cc|sharealike|share|creativecommons", "creative commons attribution share ?alike", "cc by sa", "creativecommons org licenses by sa"),
    ("cc-by-nd", "cc|noderivs|noderivatives|derivs|derivatives|creativecommons", "creative commons attribution no ?deriv(?:s|atives)", "cc by nd", "creativecommons org licenses by nd"),
    ("cc-by-nc", "cc|noncommercial|commercial|creativecommons", "creative commons attribution non ?commercial", "cc by nc", "creativecommons org licenses by nc(?= [1-4] )"),
    ("cc-by-nc-sa", "cc|noncommercial|commercial|creativecommons", "creative commons attribution non ?commercial share ?alike", "cc by nc sa", "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", "cc|noncommercial|commercial|creativecommons", "creative commons attribution non ?commercial no ?deriv(?:s|atives)", "cc by nc nd", "creativecommons org licenses by nc nd"),
    ("odbl", "odbl|database", "open database licen[sc]e", "odbl(?: 1 0)?", "opendatacommons org licenses odbl"),
)

#: priority, confidence and pattern of the ways a license is named
TEMPLATES = (
    (7, 1.0, "(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:{name}|{short})"),
    (7, 1.0, "spdx license identifier {short}"),
    (6, 0.9, "licen[sc]e (?:is |type )?{short}"),
    (5, 0.8, "{address}"),
    (4, 0.7, "{name}"),
    (3, 0.5, "{short} licen[sc]ed?"),
)

#: label, keyword, stem, pattern, priority, confidence of sentences by which a text carries a license without naming it,
#: and of names that need no other word
TEXTS = tuple((*x, 6, 0.9) for x in (
    ("mit", "hereby", "hereby granted", "permission is hereby granted free of charge(?: to any person obtaining a copy(?: of this software)?)?"),
    ("boost", "hereby", "hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("isc", "hereby", "hereby granted", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", "hereby", "hereby granted", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd", "redistribution", " binary form", "redistribution and use in source and binary forms(?: with or without modification(?: are permitted)?)?"),
    ("bsd-3", "endorse", "endorse or promote", "may be used to endorse or promote products derived from this software"),
    ("bsd-4", "advertising", "advertising materials", "advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("zlib", "liable", "held liable", "in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("unlicense", "unencumbered", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "verbatim", "verbatim", "copy and distribute verbatim or modified copies of this license document"),
    ("apache-2", "compliance", "licen", "you may not use this (?:file|work|software) except in compliance with the licen[sc]e"),
    ("apache-2", "reproduction", "licen", "licen[sc]e shall mean the terms and conditions for use reproduction and distribution"),
    ("gpl-2", "gnu", "licen", "gnu general public licen[sc]e as published by the free software foundation (?:either )?version 2(?: 0)?"),
    ("gpl-3", "gnu", "licen", "gnu general public licen[sc]e as published by the free software foundation (?:either )?version 3(?: 0)?"),
    ("lgpl-2", "gnu", "licen", "gnu (?:lesser|library) general public licen[sc]e as published by the free software foundation (?:either )?version 2(?: [01])?"),
    ("lgpl-3", "gnu", "licen", "gnu lesser general public licen[sc]e as published by the free software foundation (?:either )?version 3(?: 0)?"),
    ("agpl-3", "affero", "licen", "gnu affero general public licen[sc]e as published by the free software foundation (?:either )?version 3(?: 0)?"),
    ("mpl-2", "mozilla", "licen", "subject to the terms of the mozilla public licen[sc]e(?: version| v)? v?2(?: 0)?"),
    ("epl", "eclipse", "licen", "the accompanying program is provided under the terms of this eclipse public licen[sc]e"),
    ("openssl", "openssl", "openssl toolkit", "developed by the openssl project for use in the openssl toolkit"),
    ("cc0", "deed", "public domain", "associated a work with this deed has dedicated the work to the public domain"),
)) + tuple((label, word, word, f"{word}(?: [01])?", 3, 0.5) for label, word in (
    ("gpl-2", "gplv2"), ("gpl-3", "gplv3"), ("lgpl-2", "lgplv2"), ("lgpl-3", "lgplv3"), ("agpl-3", "agplv3"), ("mpl-1", "mplv1"), ("mpl-2", "mplv2"),
    ("epl-1", "eplv1"), ("epl-2", "eplv2"), ("apache-2", "apachev2")))

#: label, keyword, pattern, priority, confidence of what names no certain license
GENERAL = (
    ("proprietary", "reserved", "all rights reserved", 2, 0.4),
    ("public-domain", "domain", "(?:in|into|to) the public domain", 2, 0.4),
    ("gpl", "gnu|gpl", "gnu general public licen[sc]e", 2, 0.4),
    ("lgpl", "gnu|lgpl", "gnu lesser general public licen[sc]e", 2, 0.4),
    ("bsd", "bsd", "bsd licen[sc]e", 2, 0.4),
    ("creative-commons", "commons", "creative commons licen[sc]e", 2, 0.4),
    ("unknown", "license|licence|licensed|licenced", "licen[sc]ed under", 1, 0.2),
)


#: one of these stands in every text that any rule fits; single literals, which Java searches by skipping
ANY = ("licen", "cc by", "reserved", "public domain", "creative", " under ", " org ", "wtfpl", "europa eu",
       "hereby granted", " binary form", "endorse or promote", "advertising materials", "held liable", "unencumbered", "verbatim",
       "openssl toolkit", "plv", "apachev")


def rules() -> list[tuple[str, str, str, str, int, float, bool]]:
    """(label, keywords, stem, pattern, priority, confidence, base) of every rule.

    A text needs one of the keywords as a word, and the stem anywhere; short names
    such as ``mit`` are common words in some languages, so a keyword alone says little.
    """
    out = [(label, {"cc-by-nc": "cc", "apache-2": "apache"}.get(label, "mit"), "licen" if "licen" in phrase else " by ", phrase, 9, 1.0, True)
           for label, phrase in BASE]
    for label, keyword, name, short, address in FAMILIES:
        stems = (" under ", " identifier ", "licen", f" {address.split()[0]} ", "licen" if "licen" in name else " ", "licen")
        out += [(label, "|".join([keyword, *(["unlicense"] if label == "unlicense" else [])]), stem,
                 t.format(name=name, short=short, address=address), p, c, False) for (p, c, t), stem in zip(TEMPLATES, stems)]
    out += [(label, keyword, stem, pattern, p, c, False) for label, keyword, stem, pattern, p, c in TEXTS]
    return out + [(label, k, "licen" if "licen" in pattern else f" {k} ", pattern, p, c, False) for label, k, pattern, p, c in GENERAL]


def _table() -> Column:
    """The rules as one constant array."""
    rows = [{"label": label, "keywords": [f" {k} " for k in keyword.split("|")], "stem": stem, "pattern": f" (?:{pattern})(?= )",
             "priority": priority, "confidence": confidence, "base": base}
            for label, keyword, stem, pattern, priority, confidence, base in rules()]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<label:string,keywords:array<string>,stem:string,pattern:string,"
                       "priority:int,confidence:double,base:boolean>>")


def _pairs(folded: Column, pattern: Column) -> Column:
    """Blanks of the gap before each match and of the match, in order; each match begins with the blank before its first word."""
    blanks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    pairs = F.arrays_zip(F.split(folded, pattern, -1).alias("gap"), F.regexp_extract_all(folded, pattern, F.lit(0)).alias("hit"))
    return F.transform(F.filter(pairs, lambda x: x["hit"].isNotNull()), lambda x: F.struct(
        blanks(x["gap"]).alias("gap"), blanks(x["hit"]).alias("hit")))


def _with_kept(spans: DataFrame) -> DataFrame:
    """Adds ``kept``: false where another detection of the row suppresses this one.

    A detection falls if it lies within one of higher priority, or within a
    longer one of the same priority.  Of equal intervals with one priority the
    first label stays.  One pass in the order of the starts holds, for each
    priority, how far its detections have reached so far, so the work is
    n log n in the detections of a text.
    """
    reach = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("row", "priority").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy("row", "priority", "start")
    same = Window.partitionBy("row", "priority", "start", "end")
    levels = sorted({r[4] for r in rules()})
    far = spans.select("*", *[F.max(F.when(F.col("priority") == p, F.col("end"))).over(reach).alias(f"reach{p}") for p in levels])
    higher = reduce(lambda x, y: x | y, [(F.col("priority") < p) & (F.coalesce(F.col(f"reach{p}"), F.lit(-1)) >= F.col("end")) for p in levels])
    seen = far.select("*", F.max("end").over(before).alias("earlier"), F.max("end").over(here).alias("longest"), F.min("label").over(same).alias("first"))
    longer = (F.coalesce("earlier", F.lit(-1)) >= F.col("end")) | (F.col("longest") > F.col("end"))
    return seen.withColumn("kept", F.col("start").isNotNull() & ~(higher | longer | (F.col("first") < F.col("label")))).drop(
        "earlier", "longest", "first", *[f"reach{p}" for p in levels])


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``base``, ``kept``.

    ``base`` holds the places of the fixed phrases, all of them; ``kept`` the
    detections left after suppression; both as (start, end, label, priority,
    confidence) in words, end exclusive.  Texts are read once and only rule hits
    are shuffled.  Null and empty texts have no words and no detections; repeated
    rows are rows of their own; an empty table gives none; other columns are not
    looked at.  The work of a text is n log n in its hits, which are rows of one
    task.  Ties between rules go to the higher priority, the longer interval, the
    first label.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    folded = computed_once(rows, "w", F.concat(F.lit(" "), F.trim(F.regexp_replace(
        lower_ascii(F.col("text")), NOT_WORD, " ")), F.lit(" "))).drop("text")
    some = reduce(lambda a, b: a | b, [F.col("w").rlike(x) for x in ANY])
    gated = folded.select(
        "row", "doc_id", "w", F.when(F.col("w") == "  ", 0).otherwise(
            F.length("w") - F.length(F.replace("w", F.lit(" "), F.lit(""))) - 1).cast("bigint").alias("n_words"),
        F.when(some, F.filter(_table(), lambda r: F.contains(F.col("w"), r["stem"]) & F.exists(r["keywords"], lambda k: F.contains(F.col("w"), k)))).alias("rules"))
    each = gated.select("row", "doc_id", "n_words", "w", F.posexplode_outer("rules").alias("rule", "r"))
    hits = each.select("row", "doc_id", "n_words", "rule", "r.base", "r.label", "r.priority", "r.confidence", F.posexplode_outer(
        F.when(F.col("r").isNotNull(), _pairs(F.col("w"), F.col("r.pattern")))).alias("nth", "at"))
    # a rule without a hit leaves a row without a place; one a text is enough
    dealt = hits.where(F.col("at").isNotNull() | F.coalesce(F.col("rule") == 0, F.lit(True))).repartition("row")
    so_far = Window.partitionBy("row", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = dealt.withColumn("end", F.sum(F.col("at.gap") + F.col("at.hit")).over(so_far).cast("int"))
    spans = ends.select("row", "doc_id", "n_words", "base", (F.col("end") - F.col("at.hit")).cast("int").alias("start"), "end", "label", "priority", "confidence")
    span = F.struct("start", "end", "label", "priority", "confidence")
    return _with_kept(spans).groupBy("row", "doc_id", "n_words").agg(
        F.array_sort(F.collect_list(F.when(F.col("base") & F.col("start").isNotNull(), span))).alias("base"),
        F.array_sort(F.collect_set(F.when(F.col("kept"), span))).alias("kept")).drop("row")


def op8(docs: DataFrame) -> DataFrame:
    """The digest columns of the query, from the operator's detections."""
    labels = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.transform(
        F.concat(*c), lambda s: s["label"]))), ",")
    starts = F.transform("base", lambda s: s["start"].cast("bigint"))
    return scan_licenses(docs).select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(F.col("base")).alias("base_labels"),
        labels(F.col("base"), F.col("kept")).alias("labels"),
        F.coalesce(F.array_max(F.transform(F.concat("base", "kept"), lambda s: s["confidence"])), F.lit(0.0)).alias("score"))
