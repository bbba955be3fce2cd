"""The stages of the pipeline on planted rows, their exact rows against plain Python; the toxicity model is taken as given."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from conftest import words
from lumentab.llm import toxicity
from lumentab.llm.common import written

SECRET = "AKIA" + "Q7" * 8
SHARED = "AKIA" + "Z9" * 8


@pytest.fixture
def planted(spark, docs, tmp_path, monkeypatch):
    item = words(14, 77)
    near = words(120, 5)
    rows = [(i, " ".join(words(60, 100 + i)), f"s{i % 3}") for i in range(20)]  # clean
    rows += [(100 + i, f"toxic {' '.join(words(50, 200 + i))}", "s0") for i in range(3)]
    rows += [(200, " ".join(near), "s1"), (201, " ".join(near[:-2] + ["x", "y"]), "s2"), (202, " ".join(near), "s1"), (202, " ".join(near), "s1")]
    rows += [(300, " ".join(words(30, 301) + item + words(30, 302)), "s0"), (301, " ".join(words(30, 303) + item[:10]), "s1"),
             (302, " ".join(words(30, 304) + item[:9]), "s1")]
    rows += [(400, f"{' '.join(words(20, 401))} {SECRET} end", "s0")] + [(410 + i, f"{' '.join(words(20, 402 + i))} {SHARED}", f"s{i}") for i in range(3)]
    rows += [(500, None, "s0"), (501, "", "s1")]
    random.Random(1).shuffle(rows)
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    # the model as given: a text that begins with "toxic" goes
    monkeypatch.setattr(toxicity, "fit_toxicity", lambda *a: {})
    monkeypatch.setattr(toxicity, "drop_toxic", lambda d, model: d.where("text is null or not startswith(text, 'toxic ')"))
    return rows, item, str(tmp_path)


def grams(text, n):
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def brute(rows, item):
    """Rows (doc_id, text, source) after each stage but the last."""
    out = {"toxicity": (kept := [r for r in rows if not (r[1] or "").startswith("toxic ")])}
    unique = []
    for r in sorted(kept, key=lambda r: r[0]):
        same = lambda a, b: len(grams(a, 5) & grams(b, 5)) >= 0.8 * len(grams(a, 5) | grams(b, 5))
        if not (r[1] and any(u[1] and same(u[1], r[1]) for u in unique)):
            unique.append(r)
    out["near_copies"] = unique
    out["benchmark"] = clean = [r for r in unique if not (r[1] and grams(r[1], 10) & grams(" ".join(item), 10))]
    out["secrets"] = [(i, t and t.replace(SECRET, "[SECRET]"), s) for i, t, s in clean]
    return out


def test_stages_and_run_against_plain_python(spark, planted):
    rows, item, folder = planted
    want = brute(rows, item)
    assert [len(want[x]) for x in ("toxicity", "near_copies", "benchmark")] == [len(rows) - 3, len(rows) - 6, len(rows) - 8]
    d = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = written(stage(spark, d, folder), f"planted-{name}")
        got = d.collect()
        assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == Counter(want[name]), name
        assert all(r["n_chars"] == len(r["text"] or "") and r["lang"] == "en" for r in got), name
    mixed = [tuple(r[x] for x in ("doc_id", "text", "source", "copy")) for r in written(corpus_pipeline.STAGES[-1][1](spark, d, folder), "planted-mixing").collect()]
    known, copies = set(want["secrets"]), Counter(r[:3] for r in mixed)
    assert mixed and set(copies) <= known
    assert Counter(mixed) == Counter((*r, k) for r, n in copies.items() for k in range(n))
    assert Counter(tuple(r[x] for x in ("doc_id", "text", "source", "copy")) for r in corpus_pipeline.run(spark, folder).collect()) == Counter(mixed)
