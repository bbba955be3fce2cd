"""Operators over documents against brute force, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import re
from collections import Counter, defaultdict

from conftest import SMALL, words
from lumentab.llm import decontaminate, jaccard, licenses, mixing, secret_scan, substring
from lumentab.llm.common import connected_components, read
from pyspark.sql import functions as F


def odd_rows():
    a, b = words(60, 1), words(25, 2)
    long = words(30_000, 3)
    return [(1, " ".join(a)), (2, "x " + " \t".join(a[5:40]) + "\n" + " ".join(b)), (3, None), (4, ""), (5, " ".join(b + ["q"] + b)),
            (6, " ".join(["z"] * 70)), (7, " ".join(long)), (8, " ".join(long[100:20_000])), (9, " ".join(a)), (9, " ".join(a)),
            (None, " ".join(a[:30])), (10, "only a few words"), (11, "é ü ß " + " ".join(b))]


def brute_repeats(rows, width=20):
    first, out = {}, []
    order = lambda i: (-(1 << 63) if i is None else i)
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            first[k] = min(first.get(k, (order(i), p)), (order(i), p))
    for i, w in split:
        gone = set()
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < (order(i), p):
                gone |= set(range(p, p + width))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return Counter(out)


def test_substring_brute_force(docs):
    rows = odd_rows()
    assert Counter(map(tuple, substring.remove_repeats(docs(rows)).collect())) == brute_repeats(rows)
    assert substring.op1(docs([])).count() == 0


def test_substring_crowded_minimizers(docs, monkeypatch):
    monkeypatch.setattr(substring, "CROWDED", 2)
    monkeypatch.setattr(substring, "INDEX_WORDS", 100)
    line = words(10, 5)
    rows = [(i, " ".join(words(15, 10 + i % 7) + line + words(15, 20 + i % 5))) for i in range(40)]
    assert Counter(map(tuple, substring.remove_repeats(docs(rows)).collect())) == brute_repeats(rows)


def brute_links(rows, t=0.8, n=5):
    def grams(text):
        w = (text or "").encode().split()
        k = min(n, len(w))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()

    sets = [grams(x) for _, x in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return [(d, min((x for x in least[find(i)] if x is not None), default=None), links[i], len(sets[i])) for i, (d, _) in enumerate(rows)]


def near_rows():
    base, rows = words(120, 7), odd_rows()
    for i in range(30):
        w = list(base)
        for k in range(i % 6):
            w[(17 * k + i) % len(w)] = f"edit{i}_{k}"
        rows.append((100 + i, " ".join(w)))
    return rows


def test_jaccard_brute_force(docs):
    rows = near_rows()
    assert Counter(map(tuple, jaccard.op2(docs(rows)).collect())) == Counter(brute_links(rows))
    assert jaccard.op2(docs([])).count() == 0


def test_jaccard_blocks(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 4)
    rows = near_rows()
    assert Counter(map(tuple, jaccard.op2(docs(rows)).collect())) == Counter(brute_links(rows))


def test_keep_one(docs):
    rows = near_rows()
    kept = jaccard.keep_one(docs(rows))
    assert kept.columns == docs(rows).columns
    want = {c for _, c, _, n in brute_links(rows) if n and c is not None}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want | {3, 4})


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def fold(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def test_decontaminate_brute_force(spark, docs):
    item, short = words(30, 31), ["Kurz", "und", "Ü"]
    rows = [(1, "a " + " ".join(item[3:20]) + " b"), (2, " ".join(x.upper() for x in item)), (3, None), (4, ""), (5, " ".join(words(25_000, 32))),
            (6, "kurz, UND Ü!"), (7, "kurz und ü"), (8, " ".join(item[:9])), (8, " ".join(item[:9])), (None, " ".join(item[5:15]))]
    items = [(1, " ".join(item)), (2, " ".join(short)), (3, None), (4, "..."), (12, " ".join(item[10:25]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(map(tuple, decontaminate.op10(docs(rows), bench).collect()))
    want = []
    for d, t in rows:
        w, hit, who = fold(t), set(), set()
        for i, x in items:
            g = fold(x)
            k = min(10, len(g))
            grams = {tuple(g[j : j + k]) for j in range(len(g) - k + 1)} if g else set()
            for j in range(len(w) - k + 1):
                if k and tuple(w[j : j + k]) in grams:
                    hit |= set(range(j, j + k))
                    who.add(str(i))
        want.append((d, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    assert got == Counter(want)
    clean = decontaminate.decontaminate(docs(rows), bench)
    assert clean.columns == docs(rows).columns and clean.count() == sum(not w[-1] for w in want)
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs(rows), bench, remove="spans").collect()}
    assert cut[1].split() == ["a", "b"] and cut[7] == "kurz und ü"
    assert decontaminate.op10(docs(rows), bench.limit(0)).where("contaminated").count() == 0


def brute_secrets(t):
    t = t or ""
    out = []
    for k, (name, p, least, g) in enumerate((
            ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 1),
            ("access", "AKIA[A-Z0-9]+", 16, 0), ("hex", "[0-9a-f]+", 32, 0))):
        out += [(m.start(), k, m.end(), name) for m in re.finditer(p, t) if len(m.group(g)) >= least]
    return ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(out))


def test_secrets_base_and_ownership(docs):
    shared, own = "0123456789abcdef" * 2, "fedcba9876543210" * 2 + "aa"
    rows = [(1, f'é token = "{own}" x', "a"), (2, None, "a"), (3, "", "b"), (4, "token=secret:abcdefghijk Password: short1", "b"),
            (5, "AKIA" + "Z" * 12 + " AKIA1", None), (6, " ".join(words(20_000, 4)) + f" {own}", "a")]
    rows += [(10 + i, f"passwd={shared}", f"s{i}") for i in range(5)] + [(20, "key AbCdEfGhIjKlMnOpQrStUv1234 end", "c")] * 2
    got = secret_scan.scan_secrets(docs(rows)).collect()
    assert len(got) == len(rows)
    by = Counter((r["doc_id"], r["base_sha256"]) for r in secret_scan.op6(docs(rows)).collect())
    assert by == Counter((d, hashlib.sha256(brute_secrets(t).encode()).hexdigest()) for d, t, _ in rows)
    live = {r["doc_id"]: [s["live"] for s in r["spans"]] for r in got}
    assert all(live[1]) and live[1] and not any(live[12]) and live[20] == [True]
    done = secret_scan.remove_secrets(docs(rows))
    text = {r["doc_id"]: r["text"] for r in done.collect()}
    assert done.columns == docs(rows).columns and done.count() == len(rows)
    assert text[1] == 'é token = "[SECRET]" x' and text[12] == f"passwd={shared}" and text[2] is None and text[3] == ""
    assert secret_scan.op6(docs([])).count() == 0


def test_secret_spread_over_repositories_of_one_owner(docs):
    spread, own = "AbCdEfGhIjKlMnOpQrStUv1234", "ZyXwVuTsRqPoNmLkJiHgFe9876"
    rows = [(i, f"use {spread} here", "a") for i in range(4)] + [(10 + i, f"use {own} here", "a") for i in range(3)]
    df = docs(rows).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 10))
    got = {r["doc_id"]: [(s["n_repositories"], s["n_owners"], s["live"]) for s in r["spans"]] for r in secret_scan.scan_secrets(df).collect()}
    assert got == {**{i: [] for i in range(4)}, **{10 + i: [(3, 1, True)] for i in range(3)}}
    text = {r["doc_id"]: r["text"] for r in secret_scan.remove_secrets(df).collect()}
    assert text[0] == f"use {spread} here" and text[10] == "use [SECRET] here"
    loose = secret_scan.scan_secrets(df, max_repositories=4).collect()
    assert all(s["live"] for r in loose for s in r["spans"]) and all(r["spans"] for r in loose)


def test_mixing(docs):
    rows = [(i, "x" * 9, "big" if i % 3 else f"s{i % 2}") for i in range(3000)] + [(None, None, None), (7, "", "s1"), (7, "", "s1")]
    made = mixing.mix_sources(docs(rows), {None: 0.0}, extra=True)
    count = Counter(r["source"] for r in made.collect())
    assert all(abs(count[s] - sum(count.values()) / 3) < 0.15 * sum(count.values()) / 3 for s in ("big", "s0", "s1"))
    again = mixing.mix_sources(docs(rows).repartition(7), {None: 0.0}, extra=True)
    key = lambda df: Counter((r["doc_id"], r["__copy"], r["text"]) for r in df.collect())
    assert key(made) == key(again)
    assert mixing.mix_sources(docs(rows)).columns == docs(rows).columns
    gone = mixing.mix_sources(docs(rows), {"big": 0.0})
    assert gone.where("source = 'big'").count() == 0
    assert mixing.op3(docs([])).count() == 0


def test_licenses(docs):
    rows = [(1, "Released under the MIT License."), (2, "Licensed under the Apache License, Version 2.0. under the mit LICENSE"), (3, None),
            (4, ""), (5, "Lizenz mit und under the mitlicense"), (6, "cc by nc 4.0 " * 300), (7, "All rights reserved."), (7, "All rights reserved."),
            (8, "SPDX-License-Identifier: GPL-3.0"), (9, " ".join(words(30_000, 8)) + " CC BY-NC")]
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.op8(docs(rows)).collect())
    want = []
    for d, t in rows:
        w = fold(t)
        at = [(i, label) for label, p in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        first = [i for i, _ in at]
        want.append((d, len(w), len(at), min(first, default=None), max(first, default=None), ",".join(sorted({x for _, x in at}))))
    assert got == Counter(want)
    labels = {r["doc_id"]: r["labels"] for r in licenses.op8(docs(rows)).collect()}
    assert labels[1] == "mit" and labels[2] == "apache-2,mit" and labels[7] == "proprietary" and labels[8] == "gpl-3" and labels[5] == ""
    assert licenses.op8(docs([])).count() == 0


def forms(pattern):
    """All strings of a rule, a repeat at its two ends; what stands in a lookahead follows."""
    from re import _parser

    def many(seq):
        out = [""]
        for op, arg in seq:
            op = str(op)
            if op == "LITERAL":
                more = [chr(arg)]
            elif op == "IN":
                more = [chr(a if str(kind) == "LITERAL" else a[0]) for kind, a in arg]
            elif op == "MAX_REPEAT":
                more = [""] * (arg[0] == 0) + many(arg[2])
            elif op == "SUBPATTERN":
                more = many(arg[3])
            elif op == "BRANCH":
                more = [x for b in arg[1] for x in many(b)]
            else:
                assert op == "ASSERT", op
                more = many(arg[1])
            out = [a + b for a in out for b in more]
        return out

    return many(_parser.parse(pattern))


def test_every_form_of_every_license_rule_passes_its_gates():
    for label, keywords, stem, pattern, *_ in licenses.rules():
        for form in forms(pattern):
            text = f" {' '.join(form.split())} "
            assert any(f" {k} " in text for k in keywords.split("|")), (label, keywords, form)
            assert stem in text and any(x in text for x in licenses.ANY), (label, stem, form)


def test_license_spellings_and_license_texts(docs):
    want = {
        "Released under the FreeBSD License.": "bsd-2", "Licensed under GPLv3": "gpl-3", "licensed under the GPLv2 or later": "gpl-2", "GPLv3": "gpl-3",
        "Released under LGPLv2.1": "lgpl-2", "distributed under the terms of the MPLv2": "mpl-2", "Apache License v2.0": "apache-2",
        "License: Apache2": "apache-2", "licensed under the GNU GPL v3": "gpl-3", "Mozilla Public License, v. 2.0": "mpl-2", "AGPLv3 licensed": "agpl-3",
        "creative commons attribution noderivatives": "cc-by-nd", "GPL version 2.0 licensed": "gpl-2", "Released under the 3-clause BSD.": "bsd-3",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy": "boost",
        "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
        "nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-3",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
        "This is free and unencumbered software released into the public domain.": "unlicense",
        "In no event will the authors be held liable for any damages arising from the use of this software.": "zlib",
        "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1": "lgpl-2",
        "Permission was granted, free of charge; a GPL v7 and an apache 3": "",
    }
    got = {r["doc_id"]: r["labels"] for r in licenses.op8(docs(list(enumerate(want)))).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())


def test_small_tables_against_sql(spark):
    import check
    from lumentab.llm.queries import ORACLES, QUERIES

    duck = check.connect(SMALL)

    class Q:
        def __init__(self, name):
            self.name, self.oracle = name, ORACLES[name]

        def __call__(self, s, d):
            return QUERIES[self.name](s, d)

    for name in ORACLES:
        ok, message, n, _ = check.compare(spark, duck, Q(name), SMALL)
        assert ok and n, (name, message)
    assert read(spark, SMALL, "documents").select(F.count("*")).first()[0] > 0
