"""Toxicity: a support vector machine over a gapped subsequence string kernel.

The kernel of two words, ends marked, adds up their common subsequences of three
and four letters, each damped by the letters it spans, so letters put into an
insult, or left out, change it little.  Nyström landmarks turn the kernel into features, and a
squared-hinge machine is fitted on the words of labelled sentences.  Because the
kernel is an inner product of subsequence counts, the fitted machine folds into
one table by subsequence; scoring a word is a walk over its own subsequences.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentab.llm.common import written
from lumentab.llm.quality import fold

LETTERS = 48
#: subsequences are told apart by so many values of a hash, 18 bits of it
TABLE = 1 << 18
#: beginnings of words, of so many letters, that are counted beside the words
HEADS = (5, 6, 7)
SPAN = 5
DECAY = 0.6
PIECE, STEP = 20, 12
# fixed values: signs that stand for letters
SIGNS = str.maketrans("013457@$", "oieastas")
_NO_LETTER = re.compile(r"[\W\d_]+")
_SPELLED = re.compile(r"(?<!\S)(?:\w[\s.*_-]){2,}\w(?!\S)")


def plain(token: str) -> str:
    """Letters of a token: outer punctuation off, signs inside read as letters, the rest dropped."""
    return _NO_LETTER.sub("", token.strip(string.punctuation).lower().translate(SIGNS))


def tokens(text: str | None) -> set[str]:
    """Distinct tokens; letters spelled one by one also count as one token."""
    text = text or ""
    return set(text.split()).union(_NO_LETTER.sub("", m) for m in _SPELLED.findall(text))


def pieces(word: str) -> list[str]:
    """Words of up to ``PIECE`` letters are whole; longer ones are cut with overlap."""
    return [word] if len(word) <= PIECE else [word[i : i + PIECE] for i in range(0, len(word) - PIECE + STEP, STEP)]


_PLACES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index quadruples of a marked word of ``n`` letters and their weights, scaled to length 1.

    Triples name their last letter twice.
    """
    if n not in _PLACES:
        ends = [(i, min(n, i + SPAN)) for i in range(n)]
        three = [(i, j, k, k) for i, e in ends for j in range(i + 1, e) for k in range(j + 1, e)]
        four = [(i, j, k, m) for i, e in ends for j in range(i + 1, e) for k in range(j + 1, e) for m in range(k + 1, e)]
        at = np.array(three + four, np.int64).reshape(-1, 4)
        gaps = at[:, 3] - at[:, 0] - np.array([2] * len(three) + [3] * len(four))
        weight = DECAY ** gaps
        _PLACES[n] = at, weight / np.sqrt((weight**2).sum() or 1)
    return _PLACES[n]


def _codes(words: list[str]) -> np.ndarray:
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
    codes = np.full((letters.shape[1] + 2, len(words)), LETTERS - 2, np.uint32)
    codes[1:-1] = np.where((letters >= 97) & (letters <= 122), letters - 97, 26 + letters % (LETTERS - 28)).T
    codes[-1] = LETTERS - 1
    return codes


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(index of words, codes of their subsequences, weights) for each word length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        if n < 3:
            continue
        at, (places, weights) = np.flatnonzero(lengths == n), _places(int(n) + 2)
        for cut in np.array_split(at, max(1, len(at) * len(weights) // 500_000)):
            c = _codes([words[i] for i in cut])
            i, j, k, m = places.T
            last = c[m]
            last[k == m] = LETTERS - 3
            whole = ((c[i] * np.uint32(LETTERS) + c[j]) * np.uint32(LETTERS) + c[k]) * np.uint32(LETTERS) + last
            yield cut, ((whole * np.uint32(0x9E3779B1)) >> np.uint32(14)).T, weights


class Words:
    """The folded machine: a value for each subsequence and a bias."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias, self.cache = table, bias, {}

    def __getstate__(self):
        return {"table": self.table, "bias": self.bias, "cache": {}}

    def decide(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for at, codes, weights in subsequences(words):
            out[at] += weights @ self.table[codes.T]
        return out

    def known(self, wanted: set[str], limit: int = 500_000) -> dict[str, float]:
        """Values of tokens, the largest of a long token's pieces; kept between calls up to ``limit``."""
        if len(self.cache) > limit:
            self.cache = {}
        new = [t for t in wanted if t not in self.cache]
        cut = [pieces(plain(t)) for t in new]
        flat = [p for c in cut for p in c]
        if new:
            starts = np.cumsum([0, *map(len, cut[:-1])])
            self.cache.update(zip(new, np.maximum.reduceat(self.decide(flat), starts).tolist()))
        return self.cache


def _features(found: set[str], known: dict[str, float], bias: float) -> list[float]:
    """Of the word values: the three largest, how many are positive, and the number of distinct words."""
    value = np.fromiter(map(known.__getitem__, found), np.float64, len(found))
    top = np.full(3, bias)
    n = min(3, len(value))
    if n:
        top[:n] = np.sort(np.partition(value, len(value) - n)[len(value) - n :])[::-1]
    return [*np.clip(top, -3, 3).tolist(), float(np.log1p((value > 0).sum())), float(np.log1p((value > 0.5).sum())), float(np.log1p(len(value)))]


def text_features(texts: list[str | None], machine: Words, at_once: int = 1 << 20) -> np.ndarray:
    """A row per text; texts are taken together up to ``at_once`` characters, so new words meet the machine in bulk."""
    out: list[list[float]] = []
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held < at_once):
            held += len(texts[to] or "")
            to += 1
        found = [tokens(t) for t in texts[at:to]]
        known = machine.known(set().union(*found))
        out += [_features(f, known, machine.bias) for f in found]
        at = to
    return np.array(out)


def _sketch_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, sketch, word): the distinct words of a document, with two minhashes of its long ones, which copies share."""
    for b in batches:
        for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
            words = {w for t in tokens(text) for w in pieces(plain(t)) if len(w) >= 3}
            if words:
                own = words
                words = words | {w[:n] + "*" for w in words for n in HEADS if len(w) > n}
                long = [hash_word(w) for w in own if len(w) > 6] or [hash_word(w) for w in own]
                sketch = min(long) ^ min(h * 0x5851F42D4C957F2D % ((1 << 61) - 1) for h in long)
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(words), pa.int32()), pa.array([sketch] * len(words), pa.int64()),
                                                  pa.array(sorted(words))], names=["y", "sketch", "word"])


def hash_word(word: str) -> int:
    """A fixed 61-bit polynomial hash of a word."""
    h = 7
    for c in word:
        h = (h * 1_000_003 + ord(c)) % ((1 << 61) - 1)
    return h * 0x9E3779B97F4A7C15 % ((1 << 61) - 1)


def fit_words(words: list[str], y: np.ndarray, weight: np.ndarray, landmarks: int, penalty: float, seed: int) -> Words:
    """Nyström features of the kernel at ``landmarks`` words, then the machine by Newton steps."""
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y > 0), np.flatnonzero(y < 0)
    pick = lambda a, n: a[np.argsort(-weight[a] * rng.uniform(0.5, 1, len(a)), kind="stable")[:n]]
    chosen = np.concatenate([pick(good, landmarks // 2), pick(bad, landmarks - landmarks // 2)])
    marks = [words[i] for i in chosen]
    used = np.unique(np.concatenate([c.ravel() for _, c, _ in subsequences(marks)] or [np.empty(0, np.int64)]))
    place = np.full(TABLE, len(used))
    place[used] = np.arange(len(used))

    def counts(of: list[str]) -> np.ndarray:
        out = np.zeros((len(of), len(used) + 1), np.float32)
        for at, codes, w in subsequences(of):
            np.add.at(out, (at[:, None], place[codes]), np.broadcast_to(w, codes.shape))
        return out[:, :-1]

    phi = counts(marks).astype(np.float64)
    value, vector = np.linalg.eigh(phi @ phi.T)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    fold_in = phi.T @ root
    z = np.vstack([counts(words[i : i + 2000]) @ fold_in for i in range(0, len(words), 2000)])
    z = np.hstack([z, np.ones((len(z), 1))])
    share = np.where(y > 0, 0.5 / weight[good].sum(), 0.5 / weight[bad].sum()) * weight
    beta = np.zeros(z.shape[1])
    ridge = penalty * np.diag([1.0] * (z.shape[1] - 1) + [1e-6])
    for _ in range(30):
        inside = y * (z @ beta) < 1
        s, zi = share[inside], z[inside]
        step = np.linalg.solve(zi.T @ (zi * s[:, None]) + ridge, zi.T @ (s * y[inside]))
        if np.abs(step - beta).max() < 1e-8:
            break
        beta = step
    table = np.zeros(TABLE)
    table[used] = fold_in @ beta[:-1]
    return Words(table, float(beta[-1]))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / spread])
    beta = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        h = z.T @ (z * (p * (1 - p))[:, None]) + penalty * len(x) * np.eye(len(beta))
        step = np.linalg.solve(h, z.T @ (p - y) + penalty * len(x) * beta)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return beta, mean, spread


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = 4096, landmarks: int = 400,
                 vocabulary: int = 24_000, penalty: float = 1e-4, evidence: float = 11.0, least_words: int = 10,
                 seed: int = 3, doc_id: str = "doc_id", text: str = "text",
                 label: str = "toxic") -> dict | None:
    """The model, from at most ``per_class`` labelled rows of each class, taken in the order of a hash.

    Two thirds of the rows give words: a word's documents of either class are
    counted by Spark, copies once, and words of toxic sentences whose log-likelihood
    ratio reaches ``evidence``, or that share a beginning that does (and the
    ``least_words`` best ones in any case), stand against the words of clean ones.  The other third sets the
    weights of the document features.  The driver sees at most ``vocabulary``
    words and ``2 * per_class`` rows of six numbers.  ``None`` without both classes.
    """
    known = labels.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).where(
        train & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    some = [known.where(F.col("y") == y).orderBy("h").limit(per_class) for y in (0, 1)]
    sample = some[0].union(some[1])
    body = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    # the sample has a bounded number of rows of three numbers
    rows = written(body.join(F.broadcast(sample), "doc_id").select("text", "y", (F.pmod("h", F.lit(3)) < 2).alias("words")), "toxicity")
    pairs = rows.where("words").mapInArrow(_sketch_words, "y int, sketch bigint, word string")
    n = pairs.groupBy("y").agg(F.count_distinct("sketch").alias("n")).collect()
    sizes = {r["y"]: r["n"] for r in n}
    if not sizes.get(0) or not sizes.get(1):
        return None
    counted = pairs.distinct().groupBy("word").agg(F.count_if(F.col("y") == 1).alias("bad"), F.count_if(F.col("y") == 0).alias("fine"))
    n1, n0 = float(sizes[1]), float(sizes[0])
    share = (F.col("bad") + F.col("fine")) / (n1 + n0)
    part = lambda c, n: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / n / share)).otherwise(0.0)
    counted = written(counted.withColumn("more", F.col("bad") / n1 > F.col("fine") / n0).withColumn(
        "proof", part("bad", n1) + part("fine", n0)), "toxicity-words")
    clear = "more and bad >= 3 and bad * {0} > 8 * fine * {1}".format(n0, n1)
    best = counted.where(clear).where("proof > 3").orderBy(F.desc("proof"), "word").limit(vocabulary // 4).collect()
    heads = {r["word"][:-1] for r in best if r["word"].endswith("*") and r["proof"] >= evidence}
    bad = [r for r in best if not r["word"].endswith("*")]
    bad = [r for i, r in enumerate(bad) if r["proof"] >= evidence or i < least_words or any(r["word"][:n] in heads for n in HEADS)]
    fine = counted.where("(not more or proof < 2) and not endswith(word, '*')").orderBy(F.desc("fine"), F.xxhash64("word")).limit(vocabulary - vocabulary // 4).collect()
    if not bad or not fine:
        return None
    words = [r["word"] for r in (*bad, *fine)]
    y = np.array([1.0] * len(bad) + [-1.0] * len(fine))
    weight = np.log1p(np.array([float(r["bad"] if t > 0 else r["fine"] + r["bad"]) for r, t in zip((*bad, *fine), y)]))
    machine = fit_words(words, y, weight, landmarks, penalty, seed)

    def features(batches):
        for b in batches:
            x = text_features(b.column("text").to_pylist(), machine).tolist()
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    held = rows.where("not words").select("y", "text")
    seen = held.mapInArrow(features, "y int, x array<double>").collect()
    if len({r["y"] for r in seen}) < 2:
        seen = rows.select("y", "text").mapInArrow(features, "y int, x array<double>").collect()
    beta, mean, spread = logistic(np.array([r["x"] for r in seen]), np.array([float(r["y"]) for r in seen]))
    return {"machine": machine, "beta": beta, "mean": mean, "spread": spread}


def score_toxicity(docs: DataFrame, model: dict | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row; without a model every score is 0.

    Scores depend on the whole text only.  Null and empty texts have no words and
    get the score of such a text; repeated rows score alike; other columns are
    not looked at.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if model is None:
        return base.select("doc_id", F.lit(0.0).alias("score"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = text_features(b.column("text").to_pylist(), model["machine"])
                z = model["beta"][0] + ((x - model["mean"]) / model["spread"]) @ model["beta"][1:]
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return base.mapInArrow(run, f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, model: dict | None, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """``docs`` whose score is below ``threshold``; the columns stay as they are."""
    if model is None:
        return docs
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = text_features(b.column(at).to_pylist(), model["machine"])
                z = model["beta"][0] + ((x - model["mean"]) / model["spread"]) @ model["beta"][1:]
                yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit_toxicity(docs, labels, fold(4) != 2)
    return score_toxicity(docs, model).select(
        "doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
