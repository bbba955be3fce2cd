"""Substring dedup with an FM-index per shard.

Shards are made by content: a window of words belongs to the shard of its
minimizer, the least hash among its short word runs, so equal windows meet and
no shard has to be searched for every document.  Stretches of windows with one
minimizer are folded when they are equal; a shard holds the distinct stretches
of minimizers that occur more than once.  Its words become a Burrows-Wheeler
transform in a wavelet matrix with packed bits; backward search streams the
stretches over it, gives the matching statistics up to the window width, and the
suffix-array interval of every window gives its earliest place in the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentab.llm.common import row_key, written

U = np.uint64
#: words of the runs whose least hash is a window's minimizer
RUN = 6
#: bytes of text handled at once, and windows of a stretch at most
CHUNK, LONGEST = 1 << 21, 64
#: distinct stretches of one minimizer beyond which its windows are dealt one by one
CROWDED = 512
#: words of one index
INDEX_WORDS = 400_000
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(U)
_BASE, _WORD_BASE, _RUN_BASE = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(base: U, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = U(1)
    return np.multiply.accumulate(out) if n else out


def _ranges(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: U) -> np.ndarray:
    """Polynomial hashes of values[start:end], the first value with the highest power."""
    # sum of v[i] * base^-i up to a place, so a range is a difference times a power
    inverse = U(pow(int(base), -1, 1 << 64))
    total = np.concatenate([np.zeros(1, U), np.cumsum(values * _powers(inverse, len(values)), dtype=U)])
    return (total[end] - total[start]) * _powers(base, len(values) + 1)[end]


def word_hashes(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of joined texts, first word of each text); ``cuts`` are the texts' ends in bytes."""
    if len(raw) == 0:
        return np.empty(0, U), np.zeros(len(cuts), np.int64)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    first = np.zeros(len(raw) + 1, bool)
    first[np.concatenate([[0], cuts[:-1]])] = True
    start = np.flatnonzero(inside & (first[:-1] | ~np.concatenate([[False], inside[:-1]])))
    end = np.flatnonzero(inside & (first[1:] | ~np.concatenate([inside[1:], [False]]) | (np.arange(len(raw)) == len(raw) - 1))) + 1
    hashes = _mix(_ranges(_BYTE[raw], start, end, _BASE) + (end - start).astype(U))
    return hashes, np.searchsorted(start, np.concatenate([[0], cuts[:-1]]))


def stretches(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(text, place, windows, minimizer, content hash) of the runs of windows that share a minimizer."""
    n = len(words) - width + 1
    if n <= 0:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    at = np.arange(len(words))
    runs = _mix(_ranges(words, at[: len(words) - RUN + 1], at[: len(words) - RUN + 1] + RUN, _RUN_BASE))
    best, place = runs[:n].copy(), at[:n].copy()
    for k in range(1, width - RUN + 1):
        other = runs[k : k + n]
        less = other < best
        best[less], place[less] = other[less], at[k : k + n][less]
    text = np.searchsorted(first, at[:n], side="right") - 1
    last = np.concatenate([first[1:], [len(words)]])
    valid = at[:n] + width <= last[text]
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | ~valid[:-1] | (text[1:] != text[:-1])
    group = np.cumsum(new)
    start = np.flatnonzero(new)
    # long stretches, where one run is the least for long, cannot be longer than width - RUN + 1 windows
    start = start[valid[start]]
    count = np.bincount(group[valid], minlength=group[-1] + 1)[group[start]]
    content = _mix(_ranges(words, start, start + count + width - 1, _WORD_BASE) + count.astype(U))
    return text[start], start - first[text[start]], count, best[start].view(np.int64), content.view(np.int64)


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, ends) of slices of about ``CHUNK`` bytes; a longer text is a slice of its own."""
    column = pa.compute.fill_null(batch.column(name).cast(pa.large_binary()), b"") if batch.column(name).null_count else batch.column(name).cast(pa.large_binary())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        yield at, to - at, data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at]
        at = to


def _stretch_batches(width: int):
    def run(batches):
        for b in batches:
            ids = np.asarray(b.column("rid")), np.asarray(b.column("key"))
            for at, n, raw, ends in _texts(b, "text"):
                words, first = word_hashes(raw, ends)
                text, place, count, mini, content = stretches(words, first, width)
                if len(text):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                        mini, content, ids[0][at : at + n][text], ids[1][at : at + n][text], place.astype(np.int32), count.astype(np.int32))],
                        names=["mini", "content", "rid", "key", "place", "n"])
    return run


def _cut_batches(width: int):
    """Words of the wanted stretches of a text; crowded ones window by window."""
    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for rid, text, wanted in zip(b.column("rid").to_pylist(), b.column("text").to_pylist(), b.column("wanted").to_pylist()):
                words = text.encode().split()
                for w in wanted:
                    base = (w["mini"], w["content"], rid)
                    if not w["crowded"]:
                        out.append((w["mini"], *base, 0, w["n"], w["place"], b" ".join(words[w["place"] : w["place"] + w["n"] + width - 1])))
                        continue
                    for i in range(w["n"]):
                        window = b" ".join(words[w["place"] + i : w["place"] + i + width])
                        key = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)
                        out.append((key, *base, i, 1, w["place"] + i, window))
                if len(out) > 20_000:
                    yield _cut_rows(out)
                    out = []
            if out:
                yield _cut_rows(out)
    return run


_CUT = "shard bigint, mini bigint, content bigint, rid bigint, off int, n int, place int, words binary"


def _cut_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    names = [x.split()[0] for x in _CUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


class WaveletMatrix:
    """Rank of a symbol in a sequence, from one packed bit vector per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.bits, self.blocks, self.zeros = [], [], []
        start = np.arange(1 << self.levels)
        begin = np.zeros(1 << self.levels, np.int64)
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level) & 1
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
            zeros = len(bit) - int(bit.sum())
            self.bits.append(words)
            self.blocks.append(ones)
            self.zeros.append(zeros)
            up = ((start >> level) & 1).astype(bool)
            rank = self._ones(-1, begin)
            begin = np.where(up, zeros + rank, begin - rank)
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.begin = begin

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (U(1) << (at & 63).astype(U)) - U(1)
        return self.blocks[level][block] + np.bitwise_count(self.bits[level][block] & mask).astype(np.int64)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``at``."""
        for i in range(self.levels):
            up = ((symbol >> (self.levels - 1 - i)) & 1).astype(bool)
            ones = self._ones(i, at)
            at = np.where(up, self.zeros[i] + ones, at - ones)
        return at - self.begin[symbol]


class FMIndex:
    """Counts and places of word patterns of up to ``width`` words in joined stretches.

    Suffixes are ordered by their first ``width`` words, which is all that
    patterns of that length can tell apart.
    """

    def __init__(self, text: np.ndarray, size: int, width: int):
        self.text, self.width = text, width
        order = text.astype(np.int64)
        span, ranks = 1, {1: order}
        while span * 2 <= width:
            order = self._pair(order, order, span)
            span *= 2
            ranks[span] = order
        rest = width - span
        for k in sorted(ranks, reverse=True):
            if k <= rest:
                order = self._pair(order, ranks[k], span)
                span, rest = span + k, rest - k
        self.suffixes = np.argsort(order, kind="stable")
        self.wavelet = WaveletMatrix(text[self.suffixes - 1], size)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        second = np.zeros(len(b), np.int64)
        second[: len(b) - shift] = b[shift:] + 1
        return np.unique(a * (len(b) + 2) + second, return_inverse=True)[1].astype(np.int64)

    def search(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(low, high, length) of the windows that start at ``at``, word by word from their ends.

        A window whose interval falls to its own single place ends there.
        """
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.text))
        length = np.zeros(len(at), np.int64)
        alive = np.arange(len(at))
        for step in range(self.width):
            c = self.text[at[alive] + self.width - 1 - step].astype(np.int64)
            low[alive] = self.starts[c] + self.wavelet.rank(c, low[alive])
            high[alive] = self.starts[c] + self.wavelet.rank(c, high[alive])
            length[alive] = step + 1
            alive = alive[high[alive] - low[alive] > 1]
            if len(alive) == 0:
                break
        return low, high, length


_FOUND = "mini bigint, content bigint, off int, len int, frid bigint, fplace int"


def search_shard(rows: list[tuple], width: int) -> list[tuple]:
    """Runs of windows (mini, content, off, len, earliest rid, earliest place) of the stretches of one index."""
    rows.sort(key=lambda r: (r[2], r[5]))  # by place in the corpus, so the least suffix of an interval is the earliest
    ids: dict[bytes, int] = {}
    parts, lengths = [], []
    for r in rows:
        words = [ids.setdefault(w, len(ids) + 1) for w in r[6].split(b" ")]
        parts += words
        parts.append(0)
        lengths.append(len(words) + 1)
    text = np.array(parts, np.int64)
    index = FMIndex(text, len(ids) + 1, width)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    n = np.array([r[4] for r in rows])
    owner = np.repeat(np.arange(len(rows)), n)
    off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = begin[owner] + off
    low, high, length = index.search(at)
    least = at.copy()
    full = np.flatnonzero((length == width) & (high - low > 1))
    if len(full):
        keys, back = np.unique(low[full], return_inverse=True)
        ends = np.zeros(len(keys), np.int64)
        ends[back] = high[full]
        edges = np.stack([keys, ends], axis=1).ravel()
        padded = np.append(index.suffixes, len(text))
        least[full] = np.minimum.reduceat(padded, edges)[::2][back]
    home = np.searchsorted(begin, least, side="right") - 1
    shift = least - begin[home]
    out, start = [], 0
    cut = np.flatnonzero((owner[1:] != owner[:-1]) | (home[1:] != home[:-1]) | (shift[1:] != shift[:-1] + 1)) + 1
    for end in [*cut.tolist(), len(at)]:
        r, h = rows[owner[start]], rows[home[start]]
        out.append((r[0], r[1], int(r[3] + off[start]), end - start, h[2], int(h[5] + shift[start])))
        start = end
    return out


def _shard_batches(width: int):
    """Consecutive shards are indexed together up to ``INDEX_WORDS`` words; no shard is parted."""
    def emit(rows):
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
        found = search_shard(rows, width)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=[x.split()[0] for x in _FOUND.split(", ")])

    def run(batches):
        rows, words, last = [], 0, None
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for shard, *row in zip(*cols):
                if shard != last and words > INDEX_WORDS:
                    yield emit(rows)
                    rows, words = [], 0
                last = shard
                rows.append(tuple(row))
                words += row[4] + width
        if rows:
            yield emit(rows)
    return run


def _covered(runs: list[dict] | None, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for r in runs or ():
        edge[r["a"]] += 1
        edge[min(r["b"], n)] -= 1
    return np.cumsum(edge[:-1]) > 0


def _kept_batches(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, removed, texts = [], [], []
            for text, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist()):
                words = (text or "").encode().split()
                gone = _covered(runs, len(words)) if runs else None
                sizes.append(len(words))
                removed.append(0 if gone is None else int(gone.sum()))
                texts.append(b" ".join(words if gone is None else [w for w, g in zip(words, gone) if not g]))
            out = [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                   pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                out, names = [*out, pa.array(texts, pa.binary()).cast(pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(out, names=names)
    return run


def remove_repeats(docs: DataFrame, width: int = 20, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and ``kept``, the words left, joined by blanks.

    Removed is each word covered by a window of ``width`` words whose sequence also
    starts earlier: in a smaller id, or before in the same document.  Windows are
    judged on the input.  Words are what stands between ASCII blanks.

    Null and empty texts have no words; a null id comes before all others; rows
    that share an id do not come before each other, rows equal in id and text are
    treated alike; other columns are not looked at.
    """
    # the same columns for every use, so that texts are dealt by document once
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"),
                       F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63))).alias("rid"), row_key(doc_id, text).alias("key"))
    found = base.select("rid", "key", "text").mapInArrow(
        _stretch_batches(width), "mini bigint, content bigint, rid bigint, key bigint, place int, n int")
    twice = found.groupBy("mini").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("mini")
    places = written(found.join(twice, "mini"), "stretches")
    classes = places.groupBy("mini", "content").agg(F.min(F.struct("rid", "place", "key", "n")).alias("f"))
    crowded = classes.groupBy("mini").agg((F.count(F.lit(1)) > CROWDED).alias("crowded")).where("crowded")
    wanted = classes.join(crowded, "mini", "left").select(
        "f.rid", "f.key", F.struct("mini", "content", "f.place", "f.n", F.coalesce("crowded", F.lit(False)).alias("crowded")).alias("w"))
    wanted = wanted.groupBy("rid", "key").agg(F.collect_list("w").alias("wanted"))
    cut = base.join(wanted, ["rid", "key"])
    cut = cut.select("doc_id", "rid", "text", "wanted").mapInArrow(_cut_batches(width), _CUT)
    width_ = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    shards = cut.repartition(width_, "shard").sortWithinPartitions("shard")
    runs = shards.mapInArrow(_shard_batches(width), _FOUND)
    met = places.join(runs, ["mini", "content"]).where(
        (F.col("frid") < F.col("rid")) | ((F.col("frid") == F.col("rid")) & (F.col("fplace") < F.col("place") + F.col("off"))))
    gone = met.groupBy("rid", "key").agg(F.collect_list(F.struct(
        (F.col("place") + F.col("off")).alias("a"), (F.col("place") + F.col("off") + F.col("len") + width - 1).alias("b"))).alias("runs"))
    shape = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * keep_text
    return base.join(gone, ["rid", "key"], "left").select("doc_id", "rid", "text", "runs").mapInArrow(_kept_batches(keep_text), shape)


def op1(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, keep_text=False)


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM p),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r WHERE k > 1),
g AS (SELECT doc_id, list(j) AS gone FROM x GROUP BY doc_id),
y AS (SELECT d.doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
z AS (SELECT y.doc_id, string_agg(word, ' ' ORDER BY y.j) AS kept FROM y LEFT JOIN x ON y.doc_id = x.doc_id AND y.j = x.j WHERE x.j IS NULL GROUP BY y.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN z ON d.doc_id = z.doc_id
"""
