"""Alignment of two tokenizers against a brute-force version that encodes whole texts by the libraries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import SMALL, words
from lumentab.llm import align
from lumentab.llm.common import read
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def odd_texts():
    return [None, "", "a", " ", "  ", "foo ", "foo  ", " foo", "foo \n bar", "foo\n\n bar\t baz", "a  b   c", "x\x1c y\x1f z", "don't <|endoftext|> stop",
            "<s> </s> <unk> <0x41>", "▁under ▁▁ mark", "ﬁ ＡＢ é é 日本語 текст", "😀 emoji 👩‍👩‍👧", " wide  space  x", "x\u0085y \xa0z \xa0 ",
            "word " * 40, "word " * 40, "the the the", "a" * 5000, ("ab" * 300 + " ") * 3, " ".join(words(3000, 4)), "line\r\nline };\r\n x", "\n", "\n ", " \n"]


def brute(rows):
    a_side = Tokenizer.from_file(A)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = align.byte_of_letter()
    out, linked = [], []
    for doc_id, text in rows:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text, num_threads=1) if text else []
        bytes_a = [bytes(letters[c] for c in a_side.id_to_token(i)) for i in a]
        named = [b_side.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in named]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            out.append([doc_id, 0, 0, 0, 0, ""])
            linked.append(Counter())
            continue
        end_a, end_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, i, j = [], 0, 0
        for e in sorted(set(end_a) & set(end_b)):
            x, y = end_a.index(e, i) + 1, end_b.index(e, j) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        links = Counter((p, q) for x, y in groups for p in x for q in y)
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append([doc_id, len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(text.encode()).hexdigest()])
        linked.append(links)
    held = Counter(k for x in linked for k in x)
    most = defaultdict(int)
    for (p, _), n in held.items():
        most[p] = max(most[p], n)
    return Counter((*o[:5], sum(n for k, n in x.items() if held[k] == most[k[0]]), sum(n * held[k] for k, n in x.items()), o[5]) for o, x in zip(out, linked))


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("buffer,radices", [(2_000_000, 32), (300, 3)])
def test_against_whole_texts(docs, buffer, radices):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(5, "foo "), (None, "the the"), (None, "the the")]
    got = align.align_tokenizers(docs(rows), A, B, radices=radices, buffer=buffer, cell_bytes=2000).select(*COLUMNS).collect()
    assert Counter(map(tuple, got)) == brute(rows)


def test_small_table(spark):
    table = read(spark, SMALL, "documents")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    got = align.op13(table)
    assert got.columns == list(COLUMNS)
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_empty_table_and_groups(docs):
    assert align.op13(docs([])).collect() == []
    row = align.align_tokenizers(docs([(1, "some text")]), A, B).collect()[0]
    assert hashlib.sha256(row["groups"].encode()).hexdigest() == row["groups_sha256"]


def test_runs_come_back(monkeypatch):
    rng = np.random.default_rng(5)
    keys, docs, times = rng.integers(0, 1 << 30, 5000) // 1000 * 1000, rng.integers(0, 50, 5000), rng.integers(1, 9, 5000)
    want = defaultdict(int)
    for k, d, t in zip(keys.tolist(), docs.tolist(), times.tolist()):
        want[k, d] += t
    for bits in (6, 40):  # packed, and by several sort keys
        got = {}
        for run in align.sorted_runs(docs, keys, times, 32_000, 7, bits):
            p, n, d, t = align.read_run(run["pairs"], run["lengths"], run["records"], run["docs"], run["times"])
            assert np.all(np.diff(p) > 0) and set(p // 32_000 % 7) == {run["radix"]}
            got |= dict(zip(zip(np.repeat(p, n).tolist(), d.tolist()), t.tolist()))
        assert got == want
