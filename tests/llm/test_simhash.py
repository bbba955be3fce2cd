"""SimHash near duplicates against brute force over all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import SMALL, words
from lumentab.llm import simhash
from lumentab.llm.common import read


def brute_print(text, n=4):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    k = min(n, len(w))
    hashes = [xxhash.xxh64(b" ".join(w[i : i + k]), seed=42).intdigest() for i in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=4):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows))


def near_rows():
    base = words(400, 3)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "É one"), (7, "é one"), (8, "same " * 30), (None, "lonely text"), (None, " ".join(base)),
            (9, "a\x0bb\x0cc d e"), (9, "other text of the same id"), (10, " ".join(words(80_000, 9)))]
    for i in range(60):
        w = list(base)
        for k in range(i % 9):
            w[(53 * k + 7 * i) % 400] = f"edit{i}x{k}"
        rows.append((100 + i, " ".join(w)))
    return rows + [(300 + i, " ".join(words(6, i, 12))) for i in range(150)] + rows[10:30]


@pytest.mark.parametrize("block", [2048, 8])
def test_against_all_pairs(docs, block):
    rows = near_rows()
    random.Random(2).shuffle(rows)
    got = simhash.near_duplicates(docs(rows), block=block)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_small_table_and_empty(spark, docs):
    table = read(spark, SMALL, "documents")
    assert Counter(map(tuple, simhash.op12(table).collect())) == brute([(r["doc_id"], r["text"]) for r in table.collect()])
    assert simhash.op12(docs([])).collect() == []


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    prints = rng.integers(0, 1 << 63, 300, dtype=np.int64).astype(np.uint64)
    for i in range(1, 300):  # many close ones
        if i % 3:
            prints[i] = prints[i - 1] ^ np.uint64(sum(1 << b for b in set(rng.integers(0, 64, rng.integers(0, 10)).tolist())))
    planes = simhash.bit_planes(prints)
    for shift in (1, 2, 63, 64, 65, 130, 299):
        wanted = rng.random(300 - shift) < 0.8
        want = [i for i in range(300 - shift) if wanted[i] and int(prints[i] ^ prints[i + shift]).bit_count() <= radius]
        assert simhash.within(planes, shift, wanted, radius).tolist() == want


@pytest.mark.parametrize("sizes", [[500], [129], [700, 690, 650], [300, 200, 64, 3]])
def test_long_buckets_of_unrelated_fingerprints(sizes):
    """Buckets that are all longer than a shift of two words, with few lanes near each other."""
    rng, n = np.random.default_rng(5), sum(sizes)
    prints = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)
    want, start = set(), 0
    for size in sizes:  # the first and the last lane of a bucket are near each other
        i, j = start, start + size - 1
        prints[j] = prints[i] ^ np.uint64(0b1011)
        want.add((i, j))
        start += size
    assert set(simhash.spanning_links(prints, np.array(sizes), 4)) == want


@pytest.mark.parametrize("m", [5, 6, 8])
def test_buckets_miss_no_pair(m):
    masks = simhash.bucket_masks(m, 4)
    rng = random.Random(m)
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(flips & (x % (1 << 64)) == 0 for x in masks)


def test_crowded_bucket_of_near_copies(spark):
    """Chains of fingerprints in one bucket: what blocks keep apart is joined in the second round."""
    rng, rows = random.Random(8), []
    for g in range(6):
        f = rng.getrandbits(32) << 20
        for _ in range(40):
            rows.append(f)
            f ^= sum(1 << b for b in rng.sample(range(20, 52), 3))
    prints = list(dict.fromkeys(x - (1 << 64) if x >= 1 << 63 else x for x in rows))
    table = spark.createDataFrame([(i, f) for i, f in enumerate(prints)], "d bigint, f bigint")
    links = simhash.fingerprint_links(table, block=16).collect()
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        assert ((r["f1"] ^ r["f2"]) % (1 << 64)).bit_count() <= 4
        root[find(r["d1"])] = find(r["d2"])
    got = [find(i) for i in range(len(prints))]
    for i in range(len(prints)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) % (1 << 64)).bit_count() <= 4:
                assert got[i] == got[j]
    assert len(links) < 4 * len(prints)
