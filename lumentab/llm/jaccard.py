"""N-gram Jaccard join with a MinHash LSH forest.

Every document's set of word n-grams gets one label of minhashes per tree.  A
tree is a prefix trie of its labels: documents below one node share a prefix.
Matching starts at whole labels and shortens the prefix until the expected
recall at the threshold reaches its target; the nodes of that depth hold the
candidates, and every candidate pair is verified on the whole sets.

Documents with equal sets are folded first, nodes with equal members are visited
once, and large nodes are dealt as pairs of blocks, so no pair becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentab.llm.common import connected_components, free_name, row_key, written
from lumentab.llm.substring import U, _mix, _ranges, _texts, word_hashes

_GRAM_BASE = U(0xC2B2AE3D27D4EB4F)
#: shingles and documents of a block
BLOCK_SHINGLES, BLOCK_ROWS = 1_000_000, 4096


def prefix_depth(trees: int, longest: int, threshold: float, recall: float) -> int:
    """The longest prefix at which pairs at the threshold meet in some tree with the wanted probability."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    if 1 - (1 - threshold**depth) ** trees < recall:
        raise ValueError("more trees are needed for this recall")
    return depth


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams of one text; a text of fewer words is one n-gram."""
    if len(words) == 0:
        return np.empty(0, U)
    k = min(n, len(words))
    at = np.arange(len(words) - k + 1)
    return _mix(_ranges(words, at, at + k, _GRAM_BASE) + U(k))


def _per_text(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct sorted n-gram hashes) of each text of a batch."""
    for at, count, raw, ends in _texts(batch, "text"):
        words, first = word_hashes(raw, ends)
        for i, (a, b) in enumerate(zip(first, [*first[1:], len(words)])):
            yield at + i, np.unique(shingles(words[a:b], n))


def _signature_batches(n: int, trees: int, depth: int, longest: int, seed: int):
    odd = np.random.default_rng(seed).integers(1, 1 << 63, (trees, longest), dtype=np.int64).astype(U) | U(1)
    odd = odd[:, :depth].ravel()

    def run(batches):
        for b in batches:
            sums, xors, sizes, labels = [], [], [], []
            for _, s in _per_text(b, n):
                sizes.append(len(s))
                sums.append(int(s.sum(dtype=U)) if len(s) else 0)
                xors.append(int(np.bitwise_xor.reduce(_mix(s + U(1)))) if len(s) else 0)
                if not len(s):
                    labels.append([])
                    continue
                least = np.full(trees * depth, np.iinfo(np.uint64).max, U)
                for lo in range(0, len(s), 50_000):
                    least = np.minimum(least, ((s[lo : lo + 50_000, None] * odd) >> U(20)).min(axis=0))
                label = np.arange(1, trees + 1).astype(U)
                for level in range(depth):
                    label = _mix(label ^ least[level::depth])
                labels.append(label.view(np.int64).tolist())
            signed = lambda x: pa.array(np.array(x, U).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), signed(sums), signed(xors), pa.array(sizes, pa.int64()),
                                              pa.array(labels, pa.list_(pa.int64()))], names=["doc_id", "key", "s", "x", "n", "labels"])
    return run


_CELL = "label bigint, tree int, i int, j int, side int, node string, size bigint, labels array<bigint>, grams binary"


def _cell_batches(n: int):
    """A row for each cell that a candidate takes part in; ``side`` is 0, 1, or 2 for a block met by itself."""
    names = [x.split()[0] for x in _CELL.replace("array<bigint>", "array").split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.binary()]

    def run(batches):
        for b in batches:
            nodes, sizes, labels, places = (b.column(c).to_pylist() for c in ("node", "size", "labels", "places"))
            out, held = [], 0
            for r, s in _per_text(b, n):
                grams = s.tobytes()
                for p in places[r]:
                    mine = p["block"]
                    for other in range(p["blocks"]):
                        side = 2 if other == mine else int(other < mine)
                        out.append((p["label"], p["tree"], min(mine, other), max(mine, other), side, nodes[r], sizes[r], labels[r], grams))
                        held += len(grams)
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
    return run


def _common(left: list[np.ndarray], right: list[np.ndarray] | None, cells: int = 8_000_000) -> np.ndarray:
    """Sizes of all intersections of the sets, by columns of what at least two of them hold."""
    sets = left if right is None else left + right
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = held[column] > 1
    row, column = row[shared], column[shared]
    number = np.cumsum(held > 1) - 1
    column = number[column]
    width = int((held > 1).sum())
    m = len(left)
    out = np.zeros((m, m if right is None else len(right)), np.float32)
    step = max(1, cells // len(sets))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for a in range(0, width, step):
        lo, hi = np.searchsorted(column, [a, a + step])
        part = np.zeros((len(sets), min(step, width - a)), np.float32)
        part[row[lo:hi], column[lo:hi] - a] = 1
        out += part[:m] @ (part if right is None else part[m:]).T
    return out


_LINKS = "node string, links bigint, root string"


def _verify(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("side"))
        nodes = np.array(table.column("node").to_pylist(), object)
        # rows equal in id and text bring a set more than once
        first = np.sort(np.unique(nodes, return_index=True)[1])
        nodes, side = nodes[first], side[first]
        grams = table.column("grams")
        sets = [np.frombuffer(grams[int(i)].as_py(), U) for i in first]
        size = np.asarray(table.column("size"))[first].astype(np.float64)
        labels = np.array(table.column("labels").to_pylist(), np.int64)[first]
        tree = int(table.column("tree")[0].as_py())
        n = np.array([len(s) for s in sets], np.float64)
        a = np.flatnonzero(side != 1)
        b = a if (side == 2).any() else np.flatnonzero(side == 1)
        alone = b is a
        empty = pa.table({"node": pa.array([], pa.string()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.string())})
        if len(a) == 0 or len(b) == 0 or (alone and len(a) < 2):
            return empty
        both = _common([sets[i] for i in a], None if alone else [sets[i] for i in b])
        linked = np.zeros(both.shape, bool)
        scale = round(threshold * 1_000_000)
        for lo in range(0, len(a), 512):
            at = slice(lo, lo + 512)
            inter = both[at].astype(np.float64)
            ok = inter * 1_000_000 >= scale * (n[a[at]][:, None] + n[b][None, :] - inter)
            for t in range(tree):  # a pair counts in the first tree that it meets in
                ok &= labels[a[at], t][:, None] != labels[b, t][None, :]
            linked[at] = ok
        if alone:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(nodes))
        links[a] += linked @ size[b]
        if not alone:
            links[b] += linked.T @ size[a]
        root = np.arange(len(nodes))
        while True:
            before = root.copy()
            far = len(nodes)
            down = np.array([root[b[r]].min() if r.any() else far for r in linked])
            root[a] = np.minimum(root[a], down)
            across = np.array([root[a[c]].min() if c.any() else far for c in linked.T])
            root[b] = np.minimum(root[b], across)
            if (root == before).all():
                break
        has = links > 0
        return pa.table({"node": pa.array(nodes[has].tolist(), pa.string()), "links": pa.array(links[has].astype(np.int64)),
                         "root": pa.array(nodes[root[has]].tolist(), pa.string())})
    return run


def near_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = 5, trees: int = 12, longest: int = 6, recall: float = 0.999,
                    seed: int = 11, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, class_id, n_links, n_shingles.

    Two documents are linked if the Jaccard similarity of their sets of word
    n-grams is at least ``threshold``; words are what stands between ASCII blanks.
    ``class_id`` is the smallest id of the component of links, ``n_links`` the number
    of other rows linked to the row.  Every link reported is exact; a link at the
    threshold is met with probability ``recall`` or more, one above more often.

    A text of fewer than ``n`` words is one n-gram.  Null and empty texts have no
    words, no links and, together, no class but their own id.  Rows that repeat
    id and text count as rows of their own; ids may repeat with other texts; a
    null id is left out of the smallest one.  Other columns are not looked at.
    """
    depth = prefix_depth(trees, longest, threshold, recall)
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), row_key(doc_id, text).alias("key"))
    made = base.mapInArrow(_signature_batches(n, trees, depth, longest, seed),
                           "doc_id bigint, key bigint, s bigint, x bigint, n bigint, labels array<bigint>")
    rows = written(made.withColumn("node", F.when(F.col("n") > 0, F.concat(F.lpad(F.hex("s"), 16, "0"), F.lpad(F.hex("x"), 16, "0")))), "signatures")
    folded = written(rows.where("n > 0").groupBy("node").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("of"),
        F.first("labels").alias("labels"), F.first("n").alias("n")), "sets")
    tries = folded.select("node", "n", F.posexplode("labels").alias("tree", "label"))
    spots = tries.groupBy("tree", "label").agg(
        F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("node")).alias("f"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("g")).where("m > 1")
    # a node with the members of a node of an earlier tree holds no pair that is new
    spots = spots.groupBy("m", "f", "g").agg(F.min(F.struct("tree", "label", "total")).alias("b")).select(
        "b.tree", "b.label", F.ceil(F.greatest(F.col("b.total") / BLOCK_SHINGLES, F.col("m") / BLOCK_ROWS)).cast("int").alias("blocks"))
    place = F.struct("label", "tree", "blocks", F.pmod(F.xxhash64("node", "label"), F.col("blocks")).cast("int").alias("block"))
    asked = tries.join(spots, ["tree", "label"]).groupBy("node").agg(F.collect_list(place).alias("places"))
    wanted = asked.join(folded, "node").select("node", "size", "labels", "places", F.col("of.doc_id").alias("of_id"), F.col("of.key").alias("of_key"))
    d, w = base.alias("d"), wanted.alias("w")
    cells = d.join(w, (F.col("d.key") == F.col("w.of_key")) & F.col("d.doc_id").eqNullSafe(F.col("w.of_id"))).select(
        "d.text", "w.node", "w.size", "w.labels", "w.places").mapInArrow(_cell_batches(n), _CELL)
    found = written(cells.groupBy("label", "i", "j").applyInArrow(_verify(threshold), _LINKS), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    owner = folded.select("node", "size", F.col("of.doc_id").alias("least"))
    named = parts.join(owner, "node").groupBy("component").agg(F.min("least").alias("class_id"))
    classes = parts.join(named, "component").select("node", "class_id")
    per_set = owner.join(links, "node", "left").join(classes, "node", "left").select(
        "node", F.coalesce("class_id", "least").alias("class_id"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return rows.join(per_set, "node", "left").select(
        "doc_id", F.col("key").alias("row_key"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.col("n").alias("n_shingles"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class, the one with the smallest id; columns as they are.

    Of rows that share that id the one with the smallest key stays, of rows
    equal in id and text any.  Rows without words are classes by id.
    """
    judged = written(near_duplicates(docs, doc_id=doc_id, text=text, **options), "classes")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    known = judged.where("class_id is not null")
    key = free_name(docs.columns, "__key")
    best = known.groupBy("class_id").agg(F.min(rank).alias("r")).select(F.col("r.row_key").alias(key))
    # told by row, not by class: a class may hold a third of all rows
    gone = known.select(F.col("row_key").alias(key)).distinct().join(best, key, "left_anti")
    again = judged.groupBy("row_key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("row_key").alias(key))
    keyed = docs.withColumn(key, row_key(doc_id, text)).join(gone, key, "left_anti")
    single = keyed.join(again, key, "left_anti")
    return single.unionByName(keyed.join(again, key, "left_semi").dropDuplicates([key])).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).drop("row_key")
