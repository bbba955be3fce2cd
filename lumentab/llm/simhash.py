"""Near duplicates by SimHash, compared bit-sliced.

Fingerprints meet in buckets that agree on all but ``radius`` of their segments,
so no pair within the radius is missed.  The fingerprints of many buckets are
laid side by side as lanes of 64 vertical bit planes; lane i is compared with
lane i + 1, i + 2, … of its bucket for all lanes at once: planes are XORed with
their own shift and added up by carry-save adders, eight planes at a time, and
a shift is given up as soon as every lane is beyond the radius.  Lanes that are
known to be in one component are not compared again, so a bucket full of near
copies costs little more than its members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentab.llm.common import connected_components, written

U = np.uint64
SEED, BITS = 42, 64
#: members of a bucket that are compared at once; a larger bucket is dealt in blocks
BLOCK = 2048
#: lanes laid side by side, and shingles counted at once
LANES, SHINGLES = 32_768, 65_536


def fingerprint(text: str | None, n: int = 4) -> int:
    """Bit i is 1 if it is set in over half the hashes of the n-word shingles, repeats included."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    start = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
    k = min(n, len(words))
    digest = xxhash.xxh64_intdigest
    begin, end = start[: len(words) - k + 1].tolist(), (start[k:] - 1).tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(begin), SHINGLES):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(begin[at : at + SHINGLES], end[at : at + SHINGLES])], U)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(begin), bitorder="little").view(U)[0])


def _fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(t, n) for t in b.column("text").to_pylist()], U)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(f.view(np.int64))], names=["doc_id", "f"])
    return run


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """(64, words): plane j holds bit j of every fingerprint, with a spare word at its end."""
    lanes = np.zeros((BITS, (len(prints) // 64 + 2) * 64), np.uint8)
    lanes[:, : len(prints)] = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(lanes, axis=1, bitorder="little").view(U)


def _carry_save(a, b, c):
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def within(planes: np.ndarray, shift: int, wanted: np.ndarray, radius: int) -> np.ndarray:
    """The lanes i of ``wanted`` (a mask from lane 0 on) that differ from lane i + shift in at most ``radius`` bits."""
    words = -(-len(wanted) // 64)
    far = np.full(words * 64, 1, np.uint8)
    far[: len(wanted)] = ~wanted
    far = np.packbits(far, bitorder="little").view(U)
    whole, part = divmod(shift, 64)
    digits = [np.zeros(words, U) for _ in range(int(radius).bit_length())]
    for at in range(0, BITS, 8):
        moved = planes[at : at + 8, whole : whole + words]
        if part:
            moved = (moved >> U(part)) | (planes[at : at + 8, whole + 1 : whole + words + 1] << U(64 - part))
        p = planes[at : at + 8, :words] ^ moved
        # eight planes and the ones so far become one plane of ones and four of twos, and so on upwards
        level = list(p)
        for k in range(len(digits)):
            level.append(digits[k])
            carries = []
            while len(level) > 1:
                a, b = level.pop(), level.pop()
                c = level.pop() if level else None
                if c is None:
                    total, carry = a ^ b, a & b
                else:
                    total, carry = _carry_save(a, b, c)
                level.insert(0, total)
                carries.append(carry)
            digits[k] = level[0]
            level = carries
        for carry in level:
            far |= carry
        # beyond the radius: compare the counters with it, from the highest digit down
        more, same = np.zeros(words, U), ~np.zeros(words, U)
        for k in range(len(digits) - 1, -1, -1):
            if radius >> k & 1:
                same = same & digits[k]
            else:
                more |= same & digits[k]
                same = same & ~digits[k]
        if not np.any(~(far | more)):
            return np.empty(0, np.int64)
    near = np.unpackbits((~(far | more)).view(np.uint8), bitorder="little")
    return np.flatnonzero(near[: len(wanted)])


def spanning_links(prints: np.ndarray, sizes: np.ndarray, radius: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of lanes within the radius that join the components of every bucket.

    Buckets stand one after the other, the largest first, ``sizes`` lanes each.
    ``known`` labels lanes that are joined already.
    """
    planes, out = bit_planes(prints), []
    parent = np.arange(len(prints))
    if known is not None:
        first = np.unique(known, return_index=True, return_inverse=True)
        parent = first[1][first[2]]
    label = parent.copy()
    place = np.arange(len(prints)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(sizes, sizes) - place

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for shift in range(1, int(sizes.max(initial=0))):
        # the last lanes have no partner; where all buckets are longer than the shift they would reach beyond the planes
        active = min(int(sizes[sizes > shift].sum()), len(label) - shift)
        wanted = (left[:active] > shift) & (label[:active] != label[shift : shift + active])
        if not wanted.any():
            continue
        joined = False
        for i in within(planes, shift, wanted, radius).tolist():
            a, b = root(i), root(i + shift)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, i + shift))
                joined = True
        while joined:
            label = parent[parent]
            joined = not np.array_equal(label, parent)
            parent = label.copy()
    return out


_LINK = "d1 bigint, f1 bigint, d2 bigint, f2 bigint"


def _link_batches(radius: int):
    """Links of the buckets of a partition; rows of a bucket follow each other."""
    def emit(d, f, known, cuts):
        order = np.argsort(-np.diff(cuts), kind="stable")
        order = order[np.diff(cuts)[order] > 1]
        sizes = np.diff(cuts)[order]
        if not len(sizes):
            return None
        at = np.arange(sizes.sum()) + np.repeat(cuts[order] - (np.cumsum(sizes) - sizes), sizes)
        # a label of another bucket must not join lanes of this one
        mixed = None if known is None else np.stack([np.repeat(np.arange(len(sizes)), sizes), known[at]], axis=1)
        labels = None if mixed is None else np.unique(mixed, axis=0, return_inverse=True)[1].ravel()
        links = spanning_links(f[at].view(U), sizes, radius, labels)
        if not links:
            return None
        i, j = (at[np.array(x)] for x in zip(*links))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (d[i], f[i], d[j], f[j])], names=["d1", "f1", "d2", "f2"])

    def run(batches):
        held = None
        for b in batches:
            cols = [np.asarray(b.column(i)) for i in range(b.num_columns)]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in held[:4]], axis=0)) + 1
            # the last bucket may go on in the next batch
            if len(held[0]) >= LANES and len(new):
                found = emit(*(c[: new[-1]] for c in held[4:6]), _known(held, new[-1]), np.concatenate([[0], new]))
                held = [c[new[-1] :] for c in held]
                if found is not None:
                    yield found
        if held is not None and len(held[0]):
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in held[:4]], axis=0)) + 1
            found = emit(held[4], held[5], _known(held, len(held[0])), np.concatenate([[0], new, [len(held[0])]]))
            if found is not None:
                yield found
    return run


def _known(held, n):
    return held[6][:n] if len(held) > 6 else None


def segments(distinct: int, radius: int, mean: int = 1024) -> int:
    """The fewest segments whose buckets hold ``mean`` fingerprints or less on average, if bits were even."""
    m = radius + 1
    while distinct >> (BITS * (m - radius) // m) > mean and m < 4 * radius + 8:
        m += 1
    return m


def bucket_masks(m: int, radius: int) -> list[int]:
    """Bits on which two fingerprints agree, for each way of leaving out ``radius`` of ``m`` segments."""
    edge = [BITS * i // m for i in range(m + 1)]
    part = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(m)]
    masks = [sum(part[i] for i in kept) for kept in combinations(range(m), m - radius)]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in masks]


def _dealt(rows: DataFrame, radius: int, *more: str) -> DataFrame:
    """Links of the cells ``t``, ``key``, ``a``, ``b``."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cell = ["t", "key", "a", "b"]
    return rows.select(*cell, "d", "f", *more).repartition(width, *cell).sortWithinPartitions(*cell).mapInArrow(_link_batches(radius), _LINK)


def _edges(links: DataFrame) -> DataFrame:
    return links.select(F.struct(F.col("d1").alias("d"), F.col("f1").alias("f")).alias("u"), F.struct(F.col("d2").alias("d"), F.col("f2").alias("f")).alias("v"))


def fingerprint_links(prints: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """(d1, f1, d2, f2): links that join all fingerprints within the radius, directly or by way of others.

    ``prints`` holds every fingerprint ``f`` once, with a number ``d``.  A bucket of
    more than ``block`` members is dealt in blocks at first; what that joined is
    known in a second round, in which only the members outside the bucket's
    largest component meet all blocks.
    """
    masks = bucket_masks(segments(prints.count(), radius), radius)
    put = prints.select("d", "f", F.posexplode(F.array(*[F.col("f").bitwiseAND(F.lit(x)) for x in masks])).alias("t", "key"))
    sizes = put.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    sizes = written(sizes, "crowded")
    crowded = not sizes.isEmpty()
    spot = F.xxhash64("f", "t")
    if not crowded:
        return _dealt(put.withColumn("a", F.lit(0)).withColumn("b", F.lit(0)), radius)
    blocks = F.ceil(F.col("n") / block).cast("int")
    sized = put.join(sizes, ["t", "key"], "left")
    first = written(_dealt(sized.withColumn("a", F.coalesce(F.pmod(spot, blocks).cast("int"), F.lit(0))).withColumn("b", F.lit(0)), radius), "links")
    named = connected_components(_edges(first)).select("node.d", "node.f", F.col("component").alias("c"))
    full = put.join(sizes, ["t", "key"]).join(named, ["d", "f"], "left").withColumn(
        "c", F.xxhash64(F.coalesce(F.col("c.f"), F.col("f"))))
    full = written(full, "crowded-members")
    largest = full.groupBy("t", "key", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("t", "key").agg(
        F.max(F.struct("k", "c")).alias("m")).select("t", "key", "m.c", "m.k").withColumnRenamed("c", "main")
    full = full.join(largest, ["t", "key"]).withColumn("rests", F.ceil((F.col("n") - F.col("k")) / block).cast("int")).where("rests > 0")
    rest = full.where("c != main").withColumn("a", F.pmod(spot, F.col("rests")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rest_all = full.withColumn("b", F.pmod(spot, blocks).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)))
    cols = ["t", "key", "a", "b", "d", "f", "c"]
    # a member that is on both sides of a cell stands in it once
    second = _dealt(rest.select(cols).union(rest_all.select(cols)).distinct(), radius, "c")
    return first.union(second)


def _with_salt(docs: DataFrame, prints: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by ``f``, with frequent fingerprints dealt over salts.

    A fingerprint is frequent if it holds more than a quarter of an even
    partition's rows, so there are at most four for each partition and their
    table is broadcast.
    """
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    share = max(1, total // (4 * width))
    salts = F.ceil(F.col("n") / share).cast("int")
    hot = prints.where(F.col("n") > share).select("f", salts.alias("salts"))
    dealt = docs.join(F.broadcast(hot), "f", "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), "salts").cast("int"), F.lit(0))).drop("salts")
    many = F.when(F.col("n") > share, salts).otherwise(F.lit(1))
    return dealt, prints.withColumn("salt", F.explode(F.sequence(F.lit(0), many - 1)))


def near_duplicates(docs: DataFrame, radius: int = 4, n: int = 4, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable by links).

    Fingerprints are linked at ``radius`` or fewer differing bits.  Shingles are
    ``n`` words between ASCII blanks, A-Z lower-cased; a text of fewer words is
    one shingle.

    Null and empty texts have the fingerprint zero, which is linked like any
    other.  A bit that is set in exactly half the hashes is 0.  Rows that repeat
    an id are judged each; a null id is passed over when the least is sought and
    stays null where nothing else is reachable.  Long texts are hashed in full, in
    slices.  An empty table gives an empty one; other columns are not looked at.
    """
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found = written(given.mapInArrow(_fingerprints(n), "doc_id bigint, f bigint"), "fingerprints")
    nothing = F.lit((1 << 63) - 1)
    prints = written(found.groupBy("f").agg(F.coalesce(F.min("doc_id"), nothing).alias("d"), F.count(F.lit(1)).alias("n")), "distinct-prints")
    links = fingerprint_links(prints.select("d", "f"), radius, block)
    classes = connected_components(_edges(links)).select("node.d", "node.f", F.col("component.d").alias("least"))
    named = prints.join(classes, ["d", "f"], "left").select("f", "n", F.nullif(F.coalesce("least", "d"), nothing).alias("component_id"))
    named = written(named, "classes")
    total = named.agg(F.sum("n")).first()[0] or 0
    dealt, kept = _with_salt(found, named, total)
    return dealt.join(kept.drop("n"), ["f", "salt"]).select("doc_id", hex16(F.col("f")).alias("fingerprint"), "component_id")


def hex16(f: Column) -> Column:
    return F.lower(F.lpad(F.hex(f), 16, "0"))


def op12(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
