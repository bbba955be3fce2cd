"""Alignment of two tokenizers, with external spill counting of the linked token pairs.

A text is encoded twice.  Where tokens of both sides end at the same byte the
text is cut into groups; tokens of one group are linked.  How many documents of
the corpus hold an id pair linked is counted outside memory: pair-document
records are partitioned by a radix of their A id, sorted and written as
zstd-compressed runs; runs of one radix are merged by a heap that counts each
pair; in side-major order the maximum of every A id follows, and a second pass
over the same runs streams counts and maxima back to the documents.

Python is the path here because both tokenizers are libraries; Spark deals the
runs, adds up partial counts and contributions, and bounds what a task holds.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentab.llm.common import written

#: a piece of text begins with a blank that follows no other white space
PIECES = re.compile(r" +[^ ]*(?:(?<=[^\S\x1c-\x1f]) +[^ ]*)*")
_INNER_BLANK = re.compile(r"[\S\x1c-\x1f] ")
#: raw records of a run buffer; pieces of text and their characters remembered by a task
BUFFER, REMEMBERED, REMEMBERED_CHARS = 2_000_000, 400_000, 32 << 20
#: characters of documents that are encoded together
SLICE = 1 << 20
#: compressed bytes of runs that one task merges
CELL_BYTES = 32 << 20


def byte_of_letter() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: printable Latin-1 letters stand
    for themselves, the other bytes, in order, for the letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers with the bytes of their tokens.

    A is read from a byte-level BPE file.  Where its ids are its merge ranks, the
    same vocabulary is run as ranks, which is faster and gives the same ids;
    else the file's own library runs it.
    """

    def __init__(self, byte_bpe: str, pieces: str):
        import sentencepiece

        with open(byte_bpe, encoding="utf-8") as f:
            vocab = json.load(f)
        special = {t["content"] for t in vocab.get("added_tokens", ())}
        letters, model = byte_of_letter(), vocab["model"]
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ranked = all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and len(ranks) == 256 + len(merges)
        plain = vocab["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if ranked and plain and vocab["normalizer"] is None and not model["ignore_merges"]:
            import public_tokenizers
            import tiktoken

            self.encode_a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(byte_bpe)
            whole.encode_special_tokens = True
            self.encode_a = lambda text: whole.encode(text, add_special_tokens=False).ids
        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        named = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in named]
        # a text may be encoded piece by piece if no token goes on beyond a blank after other letters
        self.by_piece = not any(_INNER_BLANK.search(p.replace("▁", " ")) for p in named)

    def pieces(self, text: str) -> list[str]:
        """Parts of a blank and ``text`` that both tokenizers encode on their own."""
        if not self.by_piece:
            return [" " + text]
        found = PIECES.findall(" " + text)
        if len(found) > 1 and found[-1].isspace():
            found[-2:] = [found[-2] + found[-1]]
        return found

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides of pieces that begin with a blank; B puts the blank there itself."""
        encode = self.encode_a
        return [encode(p) for p in pieces], self.model.encode([p[1:] for p in pieces], num_threads=1)

    def whole(self, pieces: list[str], a: list[list[int]], b: list[list[int]]) -> np.ndarray:
        """Pieces that the tokens of both sides give back byte by byte."""
        raw = [p.encode() for p in pieces]
        sides = [[b"".join([table[t] for t in ids]) for ids in side] for table, side in ((self.bytes_a, a), (self.bytes_b, b))]
        return np.fromiter((x == y == z for x, y, z in zip(raw, *sides)), bool, len(raw))


def _places(counts: np.ndarray) -> np.ndarray:
    """0, 1, … within each of consecutive runs of the given lengths."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _linked(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, width_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, times) of the linked pairs of groups of ``in_a`` and ``in_b`` consecutive tokens.

    Pairs may repeat in small groups; in large ones equal ids are counted first.
    """
    at_a, at_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    large = in_a * in_b > 1024
    small = np.flatnonzero(~large)
    n_a, n_b = in_a[small], in_b[small]
    i = np.repeat(at_a[small], n_a) + _places(n_a)
    other, first = np.repeat(n_b, n_a), np.repeat(at_b[small], n_a)
    group = [np.repeat(np.repeat(small, n_a), other)]
    pair = [np.repeat(a[i], other) * width_b + b[np.repeat(first, other) + _places(other)]]
    times = [np.ones(len(pair[0]), np.int64)]
    for g in np.flatnonzero(large):
        x, n = np.unique(a[at_a[g] : at_a[g] + in_a[g]], return_counts=True)
        y, m = np.unique(b[at_b[g] : at_b[g] + in_b[g]], return_counts=True)
        group.append(np.full(len(x) * len(y), g))
        pair.append((x[:, None] * width_b + y[None, :]).ravel())
        times.append((n[:, None] * m[None, :]).ravel())
    return np.concatenate(group), np.concatenate(pair), np.concatenate(times)


class _Known:
    """What a task remembers of the pieces it has met: counts, group strings and linked pairs."""

    def __init__(self, tokens: Tokenizers):
        self.tokens, self.width_b = tokens, len(tokens.bytes_b)
        self.ids: dict[str, int] = {}
        self.strings: list[str] = []
        self.chars = 0
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (tokens.bytes_a, tokens.bytes_b))
        # ids with the mark that follows: inside a side, after side A, after a group
        self.marked = [f"{i}{m}" for n, last in ((len(tokens.bytes_a), "|"), (self.width_b, ";")) for i in range(n) for m in (",", last)]
        # A tokens, B tokens, groups, links, not whole, first pair, pairs
        self.sizes = np.zeros((0, 7), np.int64)
        self.pairs, self.times = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, pieces: list[str]) -> None:
        """Encode and align pieces not met before, all at once."""
        ids_a, ids_b = self.tokens.encode(pieces)
        good = self.tokens.whole(pieces, ids_a, ids_b)
        sizes = np.zeros((len(pieces), 7), np.int64)
        sizes[~good, 4] = 1
        kept = np.flatnonzero(good)
        strings = [""] * len(pieces)
        if len(kept):
            n_a, n_b = (np.array([len(side[i]) for i in kept], np.int64) for side in (ids_a, ids_b))
            a, b = (np.fromiter(chain.from_iterable(side[i] for i in kept), np.int64, n) for side, n in ((ids_a, n_a.sum()), (ids_b, n_b.sum())))
            # pieces are whole, so places in the joined bytes are the same on both sides
            end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
            common = np.intersect1d(end_a, end_b)
            group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
            in_a, in_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
            piece = np.searchsorted(np.cumsum(n_a), np.cumsum(in_a))  # of each group
            group, pair, times = _linked(a, b, in_a, in_b, self.width_b)
            owner = piece[group]
            order = np.argsort(owner, kind="stable")
            pair, times, owner = pair[order], times[order], owner[order]
            held = np.bincount(owner, minlength=len(kept))
            links = np.concatenate([[0], np.cumsum(times)])
            edge = np.cumsum(held)
            sizes[kept] = np.stack([n_a, n_b, np.bincount(piece, minlength=len(kept)), links[edge] - links[edge - held], np.zeros_like(n_a),
                                    len(self.pairs) + edge - held, held], axis=1)
            self.pairs, self.times = np.concatenate([self.pairs, pair]), np.concatenate([self.times, times])
            # the tokens of a group, A before B
            mark_a = np.append(group_a[1:] != group_a[:-1], True)
            mark_b = np.append(group_b[1:] != group_b[:-1], True)
            place_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]
            place_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
            text = np.empty(len(a) + len(b), np.int64)
            text[place_a] = 2 * a + mark_a
            text[place_b] = 2 * (len(self.length_a) + b) + mark_b
            marked = [self.marked[i] for i in text.tolist()]
            ends = np.cumsum(n_a + n_b).tolist()
            for i, first, end in zip(kept.tolist(), [0, *ends], ends):
                strings[i] = "".join(marked[first:end])
        first = len(self.strings)
        self.ids |= {p: first + i for i, p in enumerate(pieces)}
        self.strings += strings
        self.sizes = np.concatenate([self.sizes, sizes])
        self.chars += sum(map(len, pieces)) + sum(map(len, strings))

    def full(self) -> bool:
        return len(self.strings) > REMEMBERED or self.chars > REMEMBERED_CHARS


_STATS = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(),
          "groups_sha256": pa.string(), "groups": pa.string()}
_RUN = {"radix": pa.int32(), "records": pa.int64(), "bytes": pa.int64(), "pairs": pa.binary(), "lengths": pa.binary(), "docs": pa.binary(), "times": pa.binary()}
_WRITTEN = ("row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, "
            "radix int, records bigint, bytes bigint, pairs binary, lengths binary, docs binary, times binary")


def _rows(row, stats=None, runs=None) -> pa.RecordBatch:
    """One batch of the written table: either rows of documents or runs."""
    n = len(row)
    cols = {"row": pa.array(row, pa.int64())}
    for kind, given in ((_STATS, stats), (_RUN, runs)):
        cols |= {name: pa.array(given[name], t) if given else pa.nulls(n, t) for name, t in kind.items()}
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def sorted_runs(docs: np.ndarray, keys: np.ndarray, times: np.ndarray, width_b: int, radices: int, doc_bits: int) -> Iterator[dict]:
    """Runs by radix of the A id: (pair, document) records in side-major order, repeats added up, compressed."""
    import zstandard

    radix = (keys // width_b) % radices
    # the radix is the leading digit, so sorting once sorts every partition
    if int(keys.max(initial=0)).bit_length() + doc_bits <= 53 and radices <= 1024:
        order = np.argsort((radix << 53) | (keys << doc_bits) | docs)
    else:
        order = np.lexsort((docs, keys, radix))
    keys, docs, times, radix = keys[order], docs[order], times[order], radix[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    start = np.flatnonzero(new)
    keys, docs, radix, times = keys[start], docs[start], radix[start], np.add.reduceat(times, start)
    press = zstandard.ZstdCompressor(level=1).compress
    cuts = np.searchsorted(radix, np.arange(radices + 1))
    for r in range(radices):
        k, d, t = (x[cuts[r] : cuts[r + 1]] for x in (keys, docs, times))
        if not len(k):
            continue
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        pairs, lengths = k[first], np.diff(np.append(first, len(k)))
        out = {"pairs": press(np.diff(pairs, prepend=0).tobytes()), "lengths": press(lengths.astype(np.uint32).tobytes()),
               "docs": press(d.astype(np.uint32).tobytes()), "times": press(t.astype(np.uint32 if t.max() < 1 << 32 else np.uint64).tobytes())}
        yield {"radix": r, "records": len(k), "bytes": sum(map(len, out.values())), **out}


def read_run(pairs: bytes, lengths: bytes, records: int, docs: bytes | None = None, times: bytes | None = None):
    """(pairs, lengths, documents, times) of a run."""
    import zstandard

    un = zstandard.ZstdDecompressor().decompress
    out = [np.cumsum(np.frombuffer(un(pairs), np.int64)), np.frombuffer(un(lengths), np.uint32).astype(np.int64)]
    if docs is not None:
        raw = un(times)
        out += [np.frombuffer(un(docs), np.uint32).astype(np.int64), np.frombuffer(raw, np.uint32 if len(raw) == 4 * records else np.uint64).astype(np.int64)]
    return out


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """(ids, texts) of consecutive documents of about ``SLICE`` characters; a longer text is a slice of its own."""
    ids, texts, held = [], [], 0
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
        if texts and held + len(text or "") > SLICE:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(doc_id)
        texts.append(text)
        held += len(text or "")
    if texts:
        yield ids, texts


def _encode_batches(byte_bpe: str, pieces: str, radices: int, keep_groups: bool, buffer: int):
    def run(batches):
        from pyspark import TaskContext

        tokens = Tokenizers(byte_bpe, pieces)
        row = TaskContext.get().partitionId() << 40
        base, known, held = row, _Known(tokens), 0
        doc_of, piece_of = [], []

        def flush():
            if not held:
                return
            d, p = np.concatenate(doc_of), np.concatenate(piece_of)
            # equal pieces of a document once
            both, n = np.unique((d << 32) | p, return_counts=True)
            d, p = both >> 32, both & 0xFFFFFFFF
            begin, size = known.sizes[p, 5], known.sizes[p, 6]
            at = np.repeat(begin, size) + _places(size)
            for r in sorted_runs(np.repeat(d, size), known.pairs[at], known.times[at] * np.repeat(n, size), known.width_b, radices, max(1, int(d.max()).bit_length())):
                yield _rows([base], runs={k: [v] for k, v in r.items()})

        for batch in batches:
            for doc_ids, texts in _slices(batch):
                if known.full():
                    yield from flush()
                    base, known, held, doc_of, piece_of = row, _Known(tokens), 0, [], []
                cut = [tokens.pieces(t) if t else [] for t in texts]
                new = [p for p in dict.fromkeys(p for c in cut for p in c) if p not in known.ids]
                if new:
                    known.add(new)
                count = np.array([len(c) for c in cut], np.int64)
                ids = np.fromiter((known.ids[p] for c in cut for p in c), np.int64, count.sum())
                total = np.concatenate([np.zeros((1, 7), np.int64), np.cumsum(known.sizes[ids], axis=0)])
                sums = total[np.cumsum(count)] - total[np.cumsum(count) - count]
                good = (count > 0) & (sums[:, 4] == 0)
                sums[~good] = 0
                groups, at = [], 0
                for n, fine in zip(count.tolist(), good.tolist()):
                    groups.append("".join([known.strings[i] for i in ids[at : at + n].tolist()])[:-1] if fine else "")
                    at += n
                yield _rows(range(row, row + len(texts)), stats={
                    "doc_id": doc_ids, "n_a": sums[:, 0], "n_b": sums[:, 1], "n_groups": sums[:, 2], "n_links": sums[:, 3],
                    "groups_sha256": [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], "groups": groups if keep_groups else [None] * len(groups)})
                chosen = np.repeat(good, count)
                doc_of.append(np.repeat(np.arange(len(texts)) + row - base, count)[chosen])
                piece_of.append(ids[chosen])
                held += int(sums[:, 6].sum()) + len(ids)
                row += len(texts)
                if held > buffer:
                    yield from flush()
                    base, held, doc_of, piece_of = row, 0, [], []
        yield from flush()
    return run


def _cells(runs: DataFrame, cell_bytes: int) -> tuple[DataFrame, dict[int, int]]:
    """Runs with their cell: a radix whose runs weigh more than ``cell_bytes`` is dealt over several."""
    weight = {r["radix"]: r["b"] for r in runs.groupBy("radix").agg(F.sum("bytes").alias("b")).collect()}  # at most one row a radix
    parts = {r: max(1, math.ceil(b / cell_bytes)) for r, b in weight.items()}
    n = F.element_at(F.create_map(*[F.lit(x) for p in parts.items() for x in p]), F.col("radix")) if parts else F.lit(1)
    return runs.withColumn("part", F.pmod(F.xxhash64("row", "records"), n).cast("int")), parts


def _count(table: pa.Table) -> pa.Table:
    """Documents of each pair over the runs of a cell, by a heap over the sorted runs."""
    cols = [table.column(c).to_pylist() for c in ("pairs", "lengths", "records")]

    def stream(pairs, lengths, records):
        k, n = read_run(pairs, lengths, records)
        yield from zip(k.tolist(), n.tolist())

    keys, counts, last = [], [], None
    for key, n in heapq.merge(*[stream(*x) for x in zip(*cols)]):
        if key == last:
            counts[-1] += n
        else:
            keys.append(key)
            counts.append(n)
            last = key
    return pa.table({"pair": pa.array(keys, pa.int64()), "n": pa.array(counts, pa.int64())})


def _give_back(runs: pa.Table, counts: pa.Table) -> pa.Table:
    """(row, n_best, count_sum) of the documents in the runs of a cell; ``counts`` are the radix's pairs."""
    pair = counts.column("pair").to_numpy()
    order = np.argsort(pair)
    pair, n, best = pair[order], counts.column("n").to_numpy()[order], counts.column("best").to_numpy(zero_copy_only=False)[order]
    rows, n_best, total = [], [], []
    for base, *run in zip(*[runs.column(c).to_pylist() for c in ("row", "pairs", "lengths", "records", "docs", "times")]):
        keys, lengths, docs, times = read_run(*run)
        at = np.searchsorted(pair, keys)
        size = int(docs.max()) + 1
        summed, bests = np.zeros(size, np.int64), np.zeros(size, np.int64)
        np.add.at(summed, docs, times * np.repeat(n[at], lengths))
        np.add.at(bests, docs, times * np.repeat(best[at].astype(np.int64), lengths))
        met = np.flatnonzero(summed)
        rows.append(base + met)
        n_best.append(bests[met])
        total.append(summed[met])
    return pa.table({"row": np.concatenate(rows) if rows else np.empty(0, np.int64), "n_best": np.concatenate(n_best) if rows else np.empty(0, np.int64),
                     "count_sum": np.concatenate(total) if rows else np.empty(0, np.int64)})


def pair_counts(runs: DataFrame, width_b: int) -> DataFrame:
    """(pair, radix, n, best): documents that hold a pair, and whether it is the highest of its A id."""
    counts = runs.select("radix", "part", "pairs", "lengths", "records").groupBy("radix", "part").applyInArrow(_count, "pair bigint, n bigint")
    counts = written(counts.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    a = F.expr(f"pair div {width_b}")
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("a", "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokenizers(docs: DataFrame, byte_bpe: str, pieces: str, radices: int = 32, keep_groups: bool = True, cell_bytes: int = CELL_BYTES,
                     buffer: int = BUFFER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups.

    ``byte_bpe`` is the file of tokenizer A, ``pieces`` that of B; every executor
    must be able to read both.  ``groups`` is written ``a1,a2|b1;a3|b2,b3`` and left
    null without ``keep_groups``.

    Null and empty texts, and texts that one of the tokenizers does not give back
    byte by byte, have no tokens: zeros and an empty digest.  Every row is a
    document of its own, also when ids or texts repeat; null ids stay null.
    Links whose counts tie as highest are all best.  A long text is encoded in
    pieces that are cut where both tokenizers cut; its records are sorted at
    once.  An empty table gives an empty one; other columns are not looked at.

    Records cross the network as compressed runs, in cells of at most about
    ``cell_bytes``; a cell of a frequent A id is dealt over several tasks.  Each
    cell gives one row for a document it holds and one for a pair, and gets the
    counts of its radix, whose number the two vocabularies bound.
    """
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    table = written(given.mapInArrow(_encode_batches(byte_bpe, pieces, radices, keep_groups, buffer), _WRITTEN), "aligned")
    import sentencepiece

    width_b = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
    runs, parts = _cells(table.where("radix is not null").select("row", "radix", "records", "bytes", "pairs", "lengths", "docs", "times"), cell_bytes)
    counts = written(pair_counts(runs, width_b).withColumn("radix", F.expr(f"cast(a % {radices} as int)")), "pair-best")
    n = F.element_at(F.create_map(*[F.lit(x) for p in parts.items() for x in p]), F.col("radix")) if parts else F.lit(1)
    sent = counts.withColumn("part", F.explode(F.sequence(F.lit(0), n - 1))).select("radix", "part", "pair", "n", "best")
    back = runs.groupBy("radix", "part").cogroup(sent.groupBy("radix", "part")).applyInArrow(_give_back, "row bigint, n_best bigint, count_sum bigint")
    back = back.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return table.where("radix is null").join(back, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("bigint").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("bigint").alias("count_sum"), "groups_sha256", "groups")


def op13(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return align_tokenizers(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep_groups=False).drop("groups")
