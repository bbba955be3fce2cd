"""Places and redaction against plain Python, with very many hits in one text."""

import random
import re

from lumentab.llm import secret_scan
from test_text_operators import brute_secrets


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "en") for i, t, s in rows], "doc_id long, text string, source string, lang string")


def test_two_hundred_thousand_hits_in_one_text(spark):
    text = "é " + "".join(f"token=a{i:09d} " for i in range(200_000))
    df = frame(spark, [(1, text, "a"), (2, "nothing", "a"), (3, None, "b")])
    got = {r["doc_id"]: r for r in secret_scan.op6(df).collect()}
    assert got[1]["n_assign"] == got[1]["n_live"] == 200_000 and got[1]["spans"] == brute_secrets(text)
    assert got[2]["spans"] == got[3]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in secret_scan.remove_secrets(df).collect()}
    assert clean == {1: "é " + "token=[SECRET] " * 200_000, 2: "nothing", 3: None}


def brute_spans(text):
    """Spans of all kinds as (start, kind, end, value start); loose ones must not touch others."""
    out = []
    for k, (name, pattern, _, least) in enumerate(secret_scan.KINDS):
        for m in re.finditer(pattern, text):
            v = m.group(1)
            if len(v) >= least and (name != "entropy" or all(re.search(x, v) for x in ("[0-9]", "[A-Z]", "[a-z]"))):
                out.append((m.start(), k, m.end(), m.start(1)))
    last = len(secret_scan.KINDS) - 1
    return sorted(x for x in out if x[1] < last or not any(y[1] < last and y[0] < x[2] and x[0] < y[2] for y in out))


def test_random_texts_equal_plain_python(spark):
    rng = random.Random(8)
    bits = ["token=", "passwd: ", "AKIA", "ghp_", "-----BEGIN RSA PRIVATE KEY-----", " ", "\n", "é𝄞", '"', "/", "eyJhbGciOi.eyJzdWIiOi.x"]
    rows = []
    for i in range(150):
        run = lambda: "".join(rng.choices("abcdef0123456789" if rng.random() < 0.4 else "aB3xYz9Q-_", k=rng.choice((5, 18, 30, 45))))
        rows.append((i, "".join(rng.choice(bits) if rng.random() < 0.5 else run() for _ in range(rng.randint(0, 40))) * rng.choice((1, 1, 12)), f"s{i}"))
    rows += [rows[3], (rows[5][0], rows[5][1], "other")]  # a repeated row, and one of another source
    df = frame(spark, rows).repartition(5)
    loose = {"max_owners": 1000, "max_repositories": 1000}
    got = secret_scan.scan_secrets(df, **loose).collect()
    text = {i: t for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert [(s["start"], s["kind"], s["end"], s["vstart"]) for s in r["spans"]] == brute_spans(text[r["doc_id"]])

    def without(t):
        out, at = [], 0
        for a, b in sorted((v, e) for _, _, e, v in brute_spans(t)):
            if a >= at:
                out.append(t[at:a] + "[SECRET]")
            at = max(at, b)
        return "".join(out) + t[at:]

    clean = secret_scan.remove_secrets(df, **loose).collect()
    assert len(clean) == len(rows) and all(r["text"] == without(text[r["doc_id"]]) for r in clean)
