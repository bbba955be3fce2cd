"""Grouping of spelling variants with k-d trees over letter-count vectors.

One edit changes the letter counts of a word by at most two in L1 distance, so
the words one edit away from a word lie in a small box around it.  The splits
of an upper tree deal the vocabulary to leaves; every word goes to its own leaf
and, as a query, to each leaf whose box is near enough.  Within a leaf one k-d
tree for each length answers the queries of the same and of the next smaller
length: branches whose box is too far are pruned, the rest is compared by
count vectors, and what is left is verified letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentab.llm.common import written

#: letters after A-Z were lower-cased; letters beyond z share six counters
DIMS = 32
#: words of a leaf of the upper tree, queries answered at once, letters of a leaf's words
LEAF, QUERIES, LETTERS = 40_000, 100_000, 4_000_000
#: words the splits of the upper tree are chosen from; they only steer how even the leaves are
SAMPLE = 50_000
#: words of a leaf of a lower tree
BUCKET = 48
_MATRIX = 1 << 20


def perturbed(doc_id: int | None, run: str, rate: int = 31) -> str:
    """``run`` with one letter deleted if ``rate`` divides the CRC-32 of the id and the run."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % rate:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _word_batches(least: int, rate: int):
    """Partial counts of the words of a task; the table of a task is emptied when it grows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)
        counts: dict[str, int] = {}
        letters = 0

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if not text:
                    continue
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # bytes fold A-Z only
                for word, n in Counter(runs.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % rate == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    if word in counts:
                        counts[word] += n
                    else:
                        counts[word] = n
                        letters += len(word)
                if len(counts) > 200_000 or letters > 1 << 24:
                    yield emit()
                    counts, letters = {}, 0
        if counts:
            yield emit()
    return run


def letter_counts(words: list[bytes]) -> np.ndarray:
    """(words, 32) counts of the letters of Latin-1 words, at most 127 each; column 0 to 25 are a to z."""
    sizes = np.array([len(w) for w in words], np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    kind = np.where(raw < 0x80, raw - ord("a"), 26 + raw % 6)
    flat = np.bincount(np.repeat(np.arange(len(words)), sizes) * DIMS + kind, minlength=len(words) * DIMS)
    return np.minimum(flat, 127).astype(np.int8).reshape(len(words), DIMS)


def points(words: list[bytes]) -> np.ndarray:
    """Letter counts with the length in front."""
    sizes = np.array([[len(w)] for w in words], np.int32).reshape(-1, 1)
    return np.concatenate([sizes, letter_counts(words).astype(np.int32)], axis=1)


class UpperTree:
    """Splits ``point[dim] <= cut`` that deal words to leaves."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.dim, self.cut, self.kids = [], [], []
        self.leaves = 0
        self._grow(sample, leaves)

    def _grow(self, rows: np.ndarray, leaves: int) -> int:
        me = len(self.dim)
        self.dim.append(-1)
        self.cut.append(0)
        self.kids.append((0, 0))
        split = self._split(rows) if leaves > 1 and len(rows) > 1 else None
        if split is None:
            self.cut[me] = self.leaves
            self.leaves += 1
            return me
        self.dim[me], self.cut[me] = split
        low = rows[:, split[0]] <= split[1]
        less = min(leaves - 1, max(1, round(leaves * float(low.mean()))))
        self.kids[me] = (self._grow(rows[low], less), self._grow(rows[~low], leaves - less))
        return me

    @staticmethod
    def _split(rows: np.ndarray) -> tuple[int, int] | None:
        """The split that sends the fewest words to both sides, among those that leave a quarter on each."""
        best, n = None, len(rows)
        for quarter in (4, 50, n):
            for d in range(rows.shape[1]):
                values, counts = np.unique(rows[:, d], return_counts=True)
                below = np.cumsum(counts)
                for i in range(len(values) - 1):
                    if min(below[i], n - below[i]) * quarter >= n:
                        border = counts[i] + (counts[i + 1] if values[i + 1] == values[i] + 1 else 0)
                        rank = (border, abs(2 * int(below[i]) - n))
                        if best is None or rank < best[0]:
                            best = (rank, (d, int(values[i])))
            if best:
                return best[1]
        return None

    def home(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int32)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if self.dim[node] < 0:
                out[at] = self.cut[node]
                continue
            low = rows[at, self.dim[node]] <= self.cut[node]
            todo += [(self.kids[node][0], at[low]), (self.kids[node][1], at[~low])]
        return out

    def reached(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): leaves that may hold a word of the same or the next length one edit away.

        On the way down each letter's lack and excess against the box of the leaf
        are kept; one edit makes up for one letter too few and one too many.
        """
        found_row, found_leaf = [], []
        low, high = np.full(rows.shape[1], -(1 << 30)), np.full(rows.shape[1], 1 << 30)
        todo = [(0, np.arange(len(rows)), low, high)]
        while todo:
            node, at, low, high = todo.pop()
            if self.dim[node] < 0:
                found_row.append(at)
                found_leaf.append(np.full(len(at), self.cut[node], np.int32))
                continue
            d = self.dim[node]
            for side, kid in enumerate(self.kids[node]):
                new_low, new_high = low.copy(), high.copy()
                if side:
                    new_low[d] = max(new_low[d], self.cut[node] + 1)
                else:
                    new_high[d] = min(new_high[d], self.cut[node])
                near = at[_may_reach(rows[at], new_low, new_high)]
                if len(near):
                    todo.append((kid, near, new_low, new_high))
        return np.concatenate(found_row), np.concatenate(found_leaf)


def _may_reach(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows whose word may turn into one of the box by a replaced or an inserted letter."""
    bound = np.flatnonzero((low > -(1 << 30)) | (high < 1 << 30))
    lack, excess = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    ok = np.ones(len(rows), bool)
    for d in bound:
        if d == 0:  # the length stays or grows by one
            ok &= (rows[:, 0] <= high[0]) & (rows[:, 0] + 1 >= low[0])
            continue
        lack += np.maximum(low[d] - rows[:, d], 0)
        excess += np.maximum(rows[:, d] - high[d], 0)
    return ok & (lack <= 1) & (excess <= 1)


class LengthTree:
    """A k-d tree over the letter counts of words of one length."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.order = counts, np.arange(len(counts))
        self.nodes: list[tuple] = []  # (first, end, dim, cut, left, right, low, high)
        self._grow(0, len(counts))
        # two steps of a unary code for each letter: the distance of the codes is never more than that of the counts
        self.codes = unary(counts[self.order])

    def _grow(self, first: int, end: int) -> int:
        rows = self.counts[self.order[first:end]]
        low, high = rows.min(axis=0), rows.max(axis=0)
        me = len(self.nodes)
        self.nodes.append(())
        if end - first <= BUCKET or not (low < high).any():
            self.nodes[me] = (first, end, -1, 0, 0, 0, low, high)
            return me
        d = int(np.argmax(rows.var(axis=0)))
        cut = min(int(np.median(rows[:, d])), int(high[d]) - 1)
        left = rows[:, d] <= cut
        part = self.order[first:end]
        self.order[first:end] = np.concatenate([part[left], part[~left]])
        middle = first + int(left.sum())
        self.nodes[me] = (first, end, d, cut, self._grow(first, middle), self._grow(middle, end), low, high)
        return me

    def near(self, asks: np.ndarray, grows: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) pairs whose counts allow a replaced letter or, with ``grows``, an inserted one."""
        codes, distance = unary(asks), 1 if grows else 2
        todo = [(0, np.arange(len(asks)))]
        while todo:
            node, at = todo.pop()
            first, end, d, _, left, right, low, high = self.nodes[node]
            rows = asks[at]
            lack = np.maximum(low - rows, 0).sum(axis=1, dtype=np.int32)
            excess = np.maximum(rows - high, 0).sum(axis=1, dtype=np.int32)
            at = at[(lack <= 1) & (excess <= (0 if grows else 1))]
            if not len(at):
                continue
            if d >= 0:
                todo += [(left, at), (right, at)]
                continue
            for b in range(first, end, 4096):
                there = self.codes[b : min(b + 4096, end)]
                step = max(1, _MATRIX // len(there))
                for a in range(0, len(at), step):
                    q, w = np.nonzero(np.bitwise_count(codes[at[a : a + step], None] ^ there[None, :]) <= distance)
                    if len(q):
                        yield at[a + q], self.order[b + w]


def unary(counts: np.ndarray) -> np.ndarray:
    bits = np.concatenate([counts >= 1, counts >= 2], axis=1)
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows where ``b`` is ``a`` with exactly one letter replaced or, if wider, inserted; both are letter matrices."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    width = a.shape[1]
    ahead = np.logical_and.accumulate(a == b[:, :width], axis=1).sum(axis=1)
    back = np.logical_and.accumulate(a[:, ::-1] == b[:, ::-1][:, :width], axis=1).sum(axis=1)
    return ahead + back >= width


class _ByLength:
    """Words as letter matrices and counts, one set for each length."""

    def __init__(self, words: list[str], n: np.ndarray):
        raw = [w.encode("latin-1") for w in words]
        sizes = np.array([len(r) for r in raw])
        counts = letter_counts(raw)
        # the more frequent first, ties in order of the letters
        order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
        self.rank = np.empty(len(words), np.int64)
        self.rank[order] = np.arange(len(words))
        self.order, self.words, self.n, self.parts = np.array(order, np.int64), words, n, {}
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            self.parts[size] = (at, np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), size), counts[at])


class _Tally:
    """How many words are near each word, and the best of them."""

    def __init__(self, size: int, others: _ByLength):
        self.k, self.best, self.others = np.zeros(size, np.int64), np.full(size, 1 << 62), others

    def add(self, mine: np.ndarray, theirs: np.ndarray) -> None:
        np.add.at(self.k, mine, 1)
        np.minimum.at(self.best, mine, self.others.rank[theirs])

    def rows(self, words: list[str]) -> tuple[list, list, list, list]:
        at = np.flatnonzero(self.k)
        best = self.others.order[self.best[at]]
        return [words[i] for i in at], self.k[at].tolist(), self.others.n[best].tolist(), [self.others.words[i] for i in best]


def answer(homes: _ByLength, trees: dict[int, LengthTree], asks: _ByLength) -> pa.RecordBatch:
    """(word, k, best_n, best): near words found between the words of a leaf and some queries.

    Pairs of one length are told to the query, which meets its partner's leaf as
    its partner meets its own; pairs of two lengths are told to both.
    """
    to_ask, to_home = _Tally(len(asks.words), homes), _Tally(len(homes.words), asks)
    for size, (at, letters, counts) in asks.parts.items():
        for other in (size, size + 1):
            if other not in trees:
                continue
            where, there, _ = homes.parts[other]
            for q, w in trees[other].near(counts, other > size):
                step = max(1, (_MATRIX << 2) // other)
                for i in range(0, len(q), step):
                    a, b = q[i : i + step], w[i : i + step]
                    good = one_edit(letters[a], there[b])
                    a, b = at[a[good]], where[b[good]]
                    to_ask.add(a, b)
                    if other > size:
                        to_home.add(b, a)
    cols = [x + y for x, y in zip(to_ask.rows(asks.words), to_home.rows(homes.words))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                      names=["word", "k", "best_n", "best"])


def _route_batches(tree: UpperTree):
    def run(batches):
        for b in batches:
            words, n = b.column("word"), b.column("n")
            if not len(words):
                continue
            rows = points([w.encode("latin-1") for w in words.to_pylist()])
            row, leaf = tree.reached(rows)
            home = tree.home(rows)
            at = pa.array(np.concatenate([np.arange(len(rows)), row]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([home, leaf]), pa.int32()), pa.array(
                np.repeat([False, True], [len(rows), len(row)])), words.take(at), n.take(at)], names=["leaf", "asks", "word", "n"])
    return run


def _leaf_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of the leaves of a partition; a leaf's words come first, then its queries."""
    cell, homes, trees, words, n, asked, asked_n = None, None, {}, [], [], [], []

    def ask():
        nonlocal homes, trees, asked, asked_n
        if homes is None:
            homes = _ByLength(words, np.array(n, np.int64))
            trees = {size: LengthTree(counts) for size, (_, _, counts) in homes.parts.items()}
        out = answer(homes, trees, _ByLength(asked, np.array(asked_n, np.int64)))
        asked, asked_n = [], []
        return out

    for b in batches:
        keys = np.stack([np.asarray(b.column(i)) for i in range(3)] + [b.column("asks").to_numpy(zero_copy_only=False)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        all_words, all_n = b.column("word").to_pylist(), b.column("n").to_pylist()
        for first, end in zip(cuts, cuts[1:]):
            if first == end:
                continue
            if cell != tuple(keys[first, :3]):
                if asked:
                    yield ask()
                cell, homes, words, n = tuple(keys[first, :3]), None, [], []
            if keys[first, 3]:
                if words:  # a leaf without words has no answers
                    asked += all_words[first:end]
                    asked_n += all_n[first:end]
                    if len(asked) > 40_000:
                        yield ask()
            else:
                words += all_words[first:end]
                n += all_n[first:end]
    if asked:
        yield ask()


def near_words(vocabulary: DataFrame, leaf: int = LEAF, queries: int = QUERIES, letters: int = LETTERS) -> DataFrame:
    """(word, k, best_n, best) in parts: near words found in each leaf; words with none are left out.

    ``vocabulary`` has the distinct ``word`` of Latin-1 letters and ``n``.  A leaf of
    more words or queries than wished, as words of the same letters make it, is
    dealt over several cells, in blocks of both.
    """
    spark = vocabulary.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    total = vocabulary.count()
    if not total:
        return spark.createDataFrame([], "word string, k bigint, best_n bigint, best string")
    share = min(1.0, SAMPLE / total)
    sample = vocabulary.where((F.xxhash64(F.lit(7), "word") / float(1 << 63) + 1) / 2 < share).select("word").limit(2 * SAMPLE).collect()
    tree = UpperTree(points([r["word"].encode("latin-1") for r in sample]), -(-total // leaf))
    routed = written(vocabulary.select("word", "n").mapInArrow(_route_batches(tree), "leaf int, asks boolean, word string, n bigint"), "routed")
    size = routed.groupBy("leaf").agg(
        F.ceil(F.greatest(F.count_if(~F.col("asks")) / leaf / 2, F.sum(F.when(~F.col("asks"), F.length("word")).otherwise(0)) / letters)).alias("h"),
        F.ceil(F.count_if("asks") / queries).alias("q"))
    # one row a leaf of the tree, which the driver made
    cells = routed.join(F.broadcast(size), "leaf")
    deal = [F.when(F.col("asks") == (name == "q"), F.array(F.pmod(F.xxhash64("word"), F.greatest(name, F.lit(1))))).otherwise(
        F.sequence(F.lit(0).cast("bigint"), F.greatest(name, F.lit(1)) - 1)) for name in ("h", "q")]
    cells = cells.withColumn("hs", F.explode(deal[0])).withColumn("qs", F.explode(deal[1])).select(
        F.col("leaf").cast("bigint").alias("leaf"), "hs", "qs", "asks", "word", "n")
    dealt = cells.repartition(width, "leaf", "hs", "qs").sortWithinPartitions("leaf", "hs", "qs", "asks")
    return dealt.mapInArrow(_leaf_batches, "word string, k bigint, best_n bigint, best string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows (word, form) whose form is not null: the end of the chain of forms.

    Ways are doubled round by round; a form is ``ratio`` times as frequent as its
    word, so a chain is short and never returns.
    """
    now = written(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = written(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def spelling_variants(docs: DataFrame, least: int = 7, min_count: int = 2, ratio: int = 10, rate: int = 31,
                      doc_id: str = "doc_id", text: str = "text", leaf: int = LEAF, queries: int = QUERIES, letters: int = LETTERS) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of at least ``least`` letters and ``min_count`` occurrences.

    Words are runs of a-z, A-Z and U+00C0 to U+00FF, A-Z lower-cased; ``rate``
    deletes a letter of some runs by a checksum of id and run.  Words are near if
    one letter inserted, deleted or replaced turns one into the other.  The form
    of a word is its most frequent near word (ties: the smallest in code-point
    order) if that is ``ratio`` times as frequent; the root is the end of that chain.

    Null and empty texts have no words; a null id reads as nothing before the
    colon; every row counts, also when ids or texts repeat.  Very long runs are
    words like any other.  An empty table gives an empty one; other columns are
    not looked at.
    """
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    counted = given.mapInArrow(_word_batches(least, rate), "word string, n bigint")
    vocabulary = written(counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "vocabulary")
    found = near_words(vocabulary, leaf, queries, letters)
    none = vocabulary.select("word", "n", F.lit(0).cast("bigint").alias("k"), F.lit(None).cast("bigint").alias("best_n"), F.lit(None).cast("string").alias("best"))
    parts = none.unionByName(found.withColumn("n", F.lit(None).cast("bigint")))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), "best")))
    known = parts.groupBy("word").agg(F.max("n").alias("n"), F.sum("k").alias("n_near"), best.alias("b"))
    fits = -F.col("b.m") >= ratio * F.col("n")
    forms = written(known.select("word", "n", "n_near", F.when(fits, F.col("b.best")).alias("form"), F.when(fits, -F.col("b.m")).alias("form_n")), "forms")
    return forms.join(roots(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11(docs: DataFrame) -> DataFrame:
    return spelling_variants(docs)


OP11_SQL = r"""
WITH RECURSIVE t AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
c AS (SELECT d, w, count(*) AS n, hex(encode(d || ':' || w)) AS x FROM r WHERE length(w) >= 7 GROUP BY d, w),
h AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(x), 2), lambda k: CAST('0x' || substr(x, k + 1, 2) AS BIGINT))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h FROM c, t),
v AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
g AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (
  SELECT a.word AS a, b.word AS b FROM g a JOIN g b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, v.word FROM g JOIN v ON g.rest = v.word
  UNION SELECT v.word, g.word FROM g JOIN v ON g.rest = v.word),
q AS (SELECT a, count(*) AS n_near, arg_min(b, (-n, b)) AS best, max(n) AS best_n FROM p JOIN v ON p.b = v.word GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
  FROM v LEFT JOIN q ON v.word = q.a),
s AS (SELECT word, word AS root FROM f UNION ALL SELECT s.word, f.form FROM s JOIN f ON s.root = f.word WHERE f.form IS NOT NULL),
e AS (SELECT s.word, s.root FROM s JOIN f ON s.root = f.word WHERE f.form IS NULL)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN e ON f.word = e.word
"""
