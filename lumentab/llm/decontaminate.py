"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

The windows of the benchmark are folded to distinct ones, hashed and broadcast.
A document that holds a window of k words holds an aligned block of (k + 1) / 2
words of it, so one scan over the blocks of all documents, without a shuffle of
their texts, tells which documents need a look at every window.  A window that
meets an entry is verified word by word before it counts.  Only DataFrame
functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentab.llm.common import broadcast_checked, computed_once, folded_words, free_name, row_key, written

#: a word in a text whose letters are not folded yet
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def benchmark_windows(items: DataFrame, n: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(hash, width, gram, items): distinct windows of ``n`` words; a shorter item is one window."""
    words = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"),
                         F.explode(F.array(folded_words(F.col(text)))).alias("w")).where(F.size("w") > 0)
    wide = words.withColumn("width", F.least(F.lit(n), F.size("w")))
    cut = wide.select("item", "width", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - F.col("width") + 1), lambda i: F.slice("w", i, F.col("width")))).alias("g"))
    return cut.groupBy("width", "g").agg(F.array_sort(F.collect_set("item")).alias("items")).select(
        F.xxhash64("g").alias("hash"), "width", F.array_join("g", " ").alias("gram"), "items")


def _blocks(words: Column, width: int, k: int, step: int) -> Column:
    """Hashes of the runs of ``k`` words at every ``step``-th place, told apart by the width they serve."""
    return F.when(F.size(words) >= k, F.transform(
        F.sequence(F.lit(1), F.size(words) - k + 1, F.lit(step)), lambda i: F.xxhash64(F.lit(width), F.slice(words, i, k)))).otherwise(
        F.array().cast("array<bigint>"))


def find_contamination(docs: DataFrame, items: DataFrame, n: int = 10, max_bytes: int = 64 << 20,
                       doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``row_key``, ``doc_id``, ``n_words``, ``spans``, ``items``.

    ``spans`` are the verified windows as (start, width) in words, ordered;
    ``items`` the sorted ids, as text, of the items they belong to.  The
    benchmark is broadcast in parts of at most ``max_bytes``, so a benchmark of any
    size gives the full result.

    Null texts, empty texts and an empty benchmark give no spans; a null item id
    is called ``null``; rows equal in id and text give equal rows.
    """
    grams = written(benchmark_windows(items, n), "benchmark")
    seen = grams.agg(F.sum(F.octet_length("gram") + 64 + F.octet_length(F.array_join("items", ","))),
                     F.collect_set("width")).first()
    parts = max(1, math.ceil((seen[0] or 0) / max_bytes))
    widths = sorted(seen[1])
    keyed = docs.select(row_key(doc_id, text).alias("row_key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    words = computed_once(keyed, "w", folded_words(F.col("text"))).drop("text")
    blocks = [_blocks(F.col("w"), k, (k + 1) // 2, (k + 1) // 2) for k in widths] or [F.array().cast("array<bigint>")]
    scanned = written(words.select("row_key", "doc_id", F.size("w").cast("bigint").alias("n_words"), F.concat(*blocks).alias("blocks")), "blocks")
    flagged = None
    for k in widths:
        own = grams.where(F.col("width") == k).select(F.explode(_blocks(F.split("gram", " "), k, (k + 1) // 2, 1)).alias("block")).distinct()
        for p in range(parts):
            some = own.where(F.pmod("block", F.lit(parts)) == p)
            met = scanned.select("row_key", F.explode("blocks").alias("block")).join(F.broadcast(some), "block", "left_semi").select("row_key")
            flagged = met if flagged is None else flagged.union(met)
    counted = scanned.select("row_key", "doc_id", "n_words")
    hits = None
    if flagged is not None:
        wanted, _ = broadcast_checked(flagged.distinct(), "flagged")
        words = computed_once(keyed.join(wanted, "row_key", "left_semi"), "w", folded_words(F.col("text"))).drop("text")
    for width in widths:
        hashed = computed_once(words, "h", F.when(F.size("w") >= width, F.transform(
            F.sequence(F.lit(1), F.size("w") - width + 1), lambda i: F.xxhash64(F.slice("w", i, width)))))
        each = hashed.select("row_key", "doc_id", "w", F.posexplode("h").alias("start", "hash"))
        for p in range(parts):
            part = grams.where((F.col("width") == width) & (F.pmod("hash", F.lit(parts)) == p))
            # written as a search in an array, so that it stays a check of hits and no join key made for every window
            same = F.array_contains(F.array("gram"), F.array_join(F.slice("w", F.col("start") + 1, width), " "))
            met = each.join(F.broadcast(part), "hash").where(same)
            met = met.select("row_key", "doc_id", F.struct("start", "width").alias("span"), "items")
            hits = met if hits is None else hits.union(met)
    none = F.array().cast("array<struct<start:int,width:int>>"), F.array().cast("array<string>")
    if hits is None:
        return counted.select("*", none[0].alias("spans"), none[1].alias("items"))
    mine = hits.groupBy("row_key", "doc_id").agg(
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")).alias("b")
    a = counted.alias("a")
    same = (F.col("a.row_key") == F.col("b.row_key")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    return a.join(mine, same, "left").select(
        "a.row_key", "a.doc_id", "a.n_words", F.coalesce("b.spans", none[0]).alias("spans"),
        F.coalesce("b.items", none[1]).alias("items"))


def words_hit(spans: Column) -> Column:
    """How many words the ordered spans cover together."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(spans, start, lambda acc, s: F.struct(
        F.greatest(acc["end"], s["start"] + s["width"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), s["start"] + s["width"] - F.greatest(acc["end"], s["start"]))).alias("n")))["n"]


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` without the covered words; what stands between words stays."""
    pairs = F.arrays_zip(F.split(text, _RAW_WORD, -1).alias("gap"),
                         F.regexp_extract_all(text, F.lit(_RAW_WORD), F.lit(0)).alias("word"))
    return F.array_join(F.transform(pairs, lambda x, i: F.concat(x["gap"], F.when(F.exists(
        spans, lambda s: (s["start"] <= i) & (i < s["start"] + s["width"])), F.lit("")).otherwise(
        F.coalesce(x["word"], F.lit(""))))), "")


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "documents", **options) -> DataFrame:
    """``docs`` without contaminated documents, or with the covered words cut out (``remove="spans"``).

    The columns stay as they are; documents without a hit are passed on unchanged.
    """
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    found = find_contamination(docs, items, **options).where(F.size("spans") > 0).select(
        "row_key", "doc_id", "spans").distinct().alias("s")
    key = free_name(docs.columns, "__key")
    keyed = docs.withColumn(key, row_key(doc_id, text)).alias("d")
    same = (F.col(f"d.`{key}`") == F.col("s.row_key")) & F.col(f"d.`{doc_id}`").eqNullSafe(F.col("s.doc_id"))
    if remove == "documents":
        return keyed.join(found, same, "left_anti").select(*[F.col(f"d.`{c}`") for c in docs.columns])
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    cut = F.when(F.col("s.spans").isNull(), F.col(f"d.`{text}`")).otherwise(without_spans(F.col(f"d.`{text}`"), F.col("s.spans")))
    return keyed.join(found, same, "left").select(*[cut.alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns])


def op10(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest columns of the query, from the operator's spans and items."""
    n_hit = words_hit(F.col("spans")).cast("bigint")
    return find_contamination(docs, items).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM g),
p AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
h AS (SELECT p.doc_id, p.i, p.k, g.item_id FROM p JOIN g ON p.k = g.k AND p.gram = g.gram),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""
