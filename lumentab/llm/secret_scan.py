"""Secret scan with corpus-wide ownership frequency.

Spans come from regular expressions over whole texts.  Every found value is
hashed and counted over the corpus by distinct repositories and owners: values
held by many owners or repositories are copied examples, the others look live.  Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentab.llm.common import computed_once, free_name, row_key, written

# fixed values: the patterns of the base kinds
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{12,})"
HEX = r"(?<![0-9a-f])([0-9a-f]{32,})"
# kinds that the method adds
FORMAT = (r"(-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}"
          r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)")
ENTROPY = r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{24,})"

#: kind, pattern, a cheap test that some match needs, fewest characters of the value
KINDS = (
    ("assign", ASSIGN, lambda t: t.rlike(r"(?i:passw|secret|token|api_?key)"), 8),
    ("access", ACCESS, lambda t: t.contains("AKIA"), 16),
    ("hex", HEX, lambda t: t.rlike(r"(?<![0-9a-f])[0-9a-f]{32}"), 32),
    ("format", FORMAT, lambda t: t.rlike(r"-----BEGIN|gh[pousr]_|xox[abprs]-|eyJ"), 13),
    ("entropy", ENTROPY, lambda t: t.rlike(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24}"), 24),
)
BASE = ("assign", "access", "hex")
_HIT = "array<struct<kind:int,nth:int,gap:int,hit:int,width:int,fits:boolean,hash:string>>"
#: code points of the blocks from which a text is put together again
_BLOCK = 4096


def _hits(text: Column, order: int, pattern: str, gate, least: int) -> Column:
    """All matches of one kind in order: lengths of the gap before it, of the match and of its value, and the value's hash.

    The text between the matches comes from ``split`` with the same pattern, so
    running sums of the lengths give the places.  Matches that fail a test stay,
    as the places of later ones need them.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("value"))
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]") if KINDS[order][0] == "entropy" else F.lit(True)
    each = F.transform(F.filter(parts, lambda x: x["hit"].isNotNull()), lambda x, i: F.struct(
        F.lit(order).alias("kind"), i.alias("nth"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"),
        F.length(x["value"]).alias("width"), ((F.length(x["value"]) >= least) & mixed(x["value"])).alias("fits"),
        F.sha2(x["value"], 256).alias("hash")))
    return F.when(gate(text), each.cast(_HIT)).otherwise(F.from_json(F.lit("[]"), _HIT))


def candidates(base: DataFrame) -> DataFrame:
    """(row_key, doc_id, by, kind, start, end, vstart, hash) of the spans of all kinds, from the rows' ``hits``.

    A span of the kind ``entropy`` must hold a digit, a capital and a small
    letter and must not touch a span of the other kinds.  Places are running
    sums over the hits of a row and contact is seen by two ordered passes, so the
    work is n log n in the hits of a text.
    """
    row = ["row_key", "doc_id", "by"]
    flat = base.where(F.size("hits") > 0).select(*row, F.explode("hits").alias("s")).select(*row, "s.*")
    each = flat.repartition("row_key", "doc_id").dropDuplicates([*row, "kind", "nth"])
    so_far = Window.partitionBy(*row, "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = each.withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(so_far)).where("fits")
    spans = ends.select(*row, "kind", (F.col("end") - F.col("hit")).alias("start"), "end", (F.col("end") - F.col("width")).alias("vstart"), "hash")
    sure = F.col("kind") < len(KINDS) - 1
    before = Window.partitionBy(*row).orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*row).orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = spans.withColumn("reach", F.max(F.when(sure, F.col("end"))).over(before)).withColumn(
        "next", F.min(F.when(sure, F.col("start"))).over(after))
    apart = (F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    return seen.where(sure | apart).drop("reach", "next")


def ownership(found: DataFrame, owner: str, repository: tuple[str, ...]) -> DataFrame:
    """(hash, n_repositories, n_owners) of each value; repeated rows are folded before they are counted."""
    seen = found.select("hash", F.struct(*repository).alias("repo"), F.col(owner).alias("owner")).distinct()
    return seen.groupBy("hash").agg(F.count_distinct("repo").alias("n_repositories"),
                                    F.count_distinct(F.struct("owner")).alias("n_owners"))


def scan_secrets(docs: DataFrame, max_owners: int = 2, doc_id: str = "doc_id", text: str = "text",
                 owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), max_repositories: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``row_key``, ``doc_id`` and ``spans``.

    A span is (start, kind, end, vstart, hash, n_repositories, n_owners, live):
    places in code points, end exclusive, the value from ``vstart``, its SHA-256.
    No value is written anywhere.  A value is
    live if at most ``max_owners`` owners and at most ``max_repositories``
    repositories hold it.  Spans of the base kinds stay
    whatever their frequency; those of the added kinds are kept only if live.

    A null text is empty and has no spans; a null owner or repository counts as
    one of its own; rows equal in id and text give equal rows; an empty table
    gives none; the work of a text is n log n in its hits; other columns are not
    looked at.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    names = list(dict.fromkeys((owner, *repository)))
    base = written(docs.select(
        row_key(doc_id, text).alias("row_key"), F.col(doc_id).alias("doc_id"), F.struct(*[F.col(c) for c in names]).alias("by"),
        F.concat(*[_hits(body, i, p, g, n) for i, (_, p, g, n) in enumerate(KINDS)]).alias("hits")), "secrets")
    flat = written(candidates(base), "secret-places")
    counts = ownership(flat.select("hash", *[F.col(f"by.{c}").alias(c) for c in names]), owner, repository)
    judged = flat.join(counts, "hash").withColumn(
        "live", (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories))
    kept = judged.where(F.col("live") | (F.col("kind") < len(BASE)))
    mine = kept.groupBy("row_key", "doc_id").agg(F.array_sort(F.collect_set(F.struct(
        "start", "kind", "end", "vstart", "hash", "n_repositories", "n_owners", "live"))).alias("spans"))
    empty = F.array().cast(mine.schema["spans"].dataType)
    left, right = base.select("row_key", "doc_id").alias("a"), mine.alias("b")
    same = (F.col("a.row_key") == F.col("b.row_key")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    return left.join(right, same, "left").select("a.row_key", "a.doc_id", F.coalesce("b.spans", empty).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def cuts(spans: DataFrame) -> DataFrame:
    """(row_key, doc_id, cut): what to keep of each row with live spans.

    ``cut.kept`` lists (from, to) of the text before each mark and ``cut.rest``
    says where the text goes on after the last; overlapping values become one mark.
    """
    key = ["row_key", "doc_id"]
    live = spans.select(*key, F.explode(F.filter("spans", lambda s: s["live"])).alias("s")).select(*key, "s.vstart", "s.end").distinct()
    earlier = Window.partitionBy(*key).orderBy("vstart", "end").rowsBetween(Window.unboundedPreceding, -1)
    seen = live.withColumn("at", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    piece = F.when(F.col("vstart") >= F.col("at"), F.struct(F.col("at").cast("int").alias("from"), F.col("vstart").cast("int").alias("to")))
    return seen.groupBy(*key).agg(F.struct(F.array_sort(F.collect_list(piece)).alias("kept"), F.max("end").cast("int").alias("rest")).alias("cut"))


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))


def redact(blocks: Column, cut: Column, length: Column, mark: str = "[SECRET]") -> Column:
    """The text of ``blocks`` with a mark for each value that ``cut`` leaves out; a piece reads only the blocks it lies in."""
    def piece(start: Column, end: Column) -> Column:
        first = F.floor(start / _BLOCK).cast("int")
        met = F.slice(blocks, first + 1, F.floor(end / _BLOCK).cast("int") - first + 1)
        return F.substring(F.array_join(met, ""), start - first * _BLOCK + 1, end - start)

    before = F.array_join(F.transform(cut["kept"], lambda x: F.concat(piece(x["from"], x["to"]), F.lit(mark))), "")
    return F.concat(before, piece(cut["rest"], length))


def remove_secrets(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the values of live spans replaced by a mark; the columns stay as they are.

    Rows without any candidate, nearly all, are passed on where they are; only
    the others are joined with their spans.
    """
    text, doc_id = options.get("text", "text"), options.get("doc_id", "doc_id")
    body = F.coalesce(F.col(text), F.lit(""))
    gated = None
    for _, _, gate, _ in KINDS:
        gated = gate(body) if gated is None else gated | gate(body)
    found = cuts(scan_secrets(docs.where(gated), **options)).alias("s")
    names = list(docs.columns)
    for name in ("__key", "__cut", "__blocks"):
        names.append(free_name(names, name))
    key, cut, blocks = names[-3:]
    keyed = docs.where(gated).withColumn(key, row_key(doc_id, text)).alias("d")
    met = keyed.join(found, (F.col(f"d.`{key}`") == F.col("s.row_key")) & F.col(f"d.`{doc_id}`").eqNullSafe(F.col("s.doc_id")), "left")
    met = met.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.col("s.cut").alias(cut))
    met = computed_once(met, blocks, F.when(F.col(f"`{cut}`").isNotNull(), _blocks(F.col(f"`{text}`"))))
    whole = F.col(f"`{text}`")
    clean = F.when(F.col(f"`{cut}`").isNotNull(), redact(F.col(f"`{blocks}`"), F.col(f"`{cut}`"), F.length(whole))).otherwise(whole)
    return docs.where(~gated).unionByName(met.select(*[clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]))


def op6(docs: DataFrame) -> DataFrame:
    """The digest columns of the query, from the operator's spans."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return scan_secrets(docs).select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("bigint").alias("n_live"))
