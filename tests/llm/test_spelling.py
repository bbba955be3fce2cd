"""Spelling variants against brute force and the SQL twin."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import SMALL
from lumentab.llm import spelling
from lumentab.llm.common import read


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            n[low if h % 31 else low[: h % len(low)] + low[h % len(low) + 1 :]] += 1
    words = [w for w, k in n.items() if len(w) >= 7 and k >= 2]
    others = {w: [v for v in words if near(w, v)] for w in words}
    form = {w: min(v, key=lambda x: (-n[x], x)) if v else None for w, v in others.items()}
    form = {w: f if f and n[f] >= 10 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return Counter((w, form[w], root(w), n[w], len(others[w]), n[form[w]] if form[w] else None) for w in words)


def odd_rows():
    r = random.Random(4)
    text = []
    for stem, k in (("letters", 400), ("lettersx", 30), ("letterxx", 3), ("élégance", 60), ("elégance", 2), ("sentence", 90), ("scentence", 8), ("réunion", 25), ("r×union", 2),
                    ("aaaaaaa", 30), ("aaaaaaaa", 3), ("baaaaaa", 3), ("tsetler", 40), ("ÀÉÎÕÜÿß", 5), ("àÉÎÕÜÿß", 50)):
        text += [stem] * k
    text += ["z" * 300] * 40 + ["z" * 301] * 2
    for _ in range(400):  # many words of the same letters
        text += ["".join(r.sample("abcdefg", 7))] * r.choice((2, 2, 25))
    r.shuffle(text)
    rows = [(i, " ".join(text[i::7]) + ", END. Short " + "Sentence-SENTENCE") for i in range(7)]
    return rows + [(None, "letters Letters"), (8, None), (9, ""), (3, "sentence scentence"), (3, "sentence scentence")]


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("bounds", [{}, {"leaf": 20, "queries": 50, "letters": 300}])
def test_against_brute_force(docs, bounds):
    rows = odd_rows()
    got = spelling.spelling_variants(docs(rows), **bounds)
    assert got.columns == COLUMNS
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_sql_twin_and_empty(spark, docs):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({spelling.OP11_SQL})").fetchall()
    assert want and Counter(map(tuple, spelling.op11(read(spark, SMALL, "documents")).collect())) == Counter(want)
    assert spelling.op11(docs([])).collect() == []


def test_chain_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)] + [("w11", None), ("alone", None)], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(forms).collect()} == {f"w{i}": "w11" for i in range(11)}


def test_letter_order_is_verified():
    def matrix(words):
        return np.array([list(w.encode("latin-1")) for w in words], np.uint8)

    words = ["abcdefg", "abcdegf", "xbcdefg", "abcdefh"]
    longer = ["abcdefgh", "aabcdefg", "abcdxefg", "abcdegfx"]
    for w in words:
        for v in words:
            assert spelling.one_edit(matrix([w]), matrix([v]))[0] == near(w, v)
        for v in longer:
            assert spelling.one_edit(matrix([w]), matrix([v]))[0] == near(w, v)


def test_upper_tree_reaches_every_near_word():
    r = random.Random(1)
    words = sorted({"".join(r.choices("abcdeé", k=r.randrange(7, 10))).encode("latin-1") for _ in range(500)})
    rows = spelling.points(words)
    tree = spelling.UpperTree(rows, 24)
    home = tree.home(rows)
    reached = set(zip(*(x.tolist() for x in tree.reached(rows))))
    assert tree.leaves > 8
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if len(b) >= len(a) and near(a.decode("latin-1"), b.decode("latin-1")):
                assert (i, home[j]) in reached
