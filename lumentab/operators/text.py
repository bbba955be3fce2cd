"""Tokens, bags of words, tf-idf and multinomial naive Bayes in long form.

A bag of words stays a table (doc, term, tf): its size follows the text, not
documents x vocabulary, and no vocabulary passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentab.operators.joins import BROADCAST_BYTES
from lumentab.session import ensure_checkpoint_dir

# fixed values: blanks of the scripting language, word of two or more word characters
BLANKS = r"[\t\n\x0b\f\r\x1c-\x1f\x{85}\p{Z}]+"
WORD = r"[\p{L}\p{N}_]{2,}"


def clean_words(text: Column, stop_words: Sequence[str]) -> Column:
    """Drop ASCII punctuation characters, split on blanks, drop stop words.

    Case is kept; only the stop-word test ignores it.
    """
    parts = F.split(F.regexp_replace(text, r"\p{Punct}", ""), BLANKS)
    return F.filter(parts, lambda w: (w != "") & ~F.lower(w).isin(list(stop_words)))


def default_stop_words() -> list[str]:
    """English list that ships with Spark ML (needs a running session)."""
    return StopWordsRemover.loadDefaultStopWords("english")


def tokens(text: Column) -> Column:
    """Lower-cased runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def bag_of_words(df: DataFrame, doc: str, words: Column) -> DataFrame:
    """(doc, term, tf) with the other columns of ``df`` kept; counted per task before the shuffle."""
    kept = [x for x in df.columns if x != "text"]
    return df.select(*kept, F.explode(words).alias("term")).groupBy(*kept, "term").agg(F.count(F.lit(1)).alias("tf"))


def bag_shape(bag: DataFrame, doc: str) -> DataFrame:
    """Documents, vocabulary, non-zero cells and total of a bag."""
    return bag.agg(F.count_distinct(doc).alias("n_docs"), F.count_distinct("term").alias("n_terms"),
                   F.count(F.lit(1)).alias("non_zero"), F.sum("tf").alias("total"))


def tfidf(bag: DataFrame, doc: str, n_docs: Column, most_terms: int = 1_000_000) -> DataFrame:
    """tf * (ln((1+n)/(1+df)) + 1), scaled to length 1 per document.

    A frequent term is a hot join key, so document frequencies are broadcast: those of the
    ``most_terms`` most frequent terms, or of as many as stay in ``BROADCAST_BYTES``.  A term that is in one
    document needs no entry.  What is left, terms in few documents, meets its
    frequencies in a shuffled join of those rows only; without such terms a bag that lies by
    document is not dealt anew.  A document holds at most one row per term, which bounds
    the window for its length.
    """
    ensure_checkpoint_dir(bag.sparkSession)
    known = bag.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1).checkpoint()
    # one row per document frequency: how many terms have it, and their bytes
    sizes = known.groupBy("df").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term") + 24).alias("b"))
    above = Window.orderBy(F.desc("df"))
    fits = sizes.withColumns({"n": F.sum("n").over(above), "b": F.sum("b").over(above)}).where(
        (F.col("n") <= most_terms) & (F.col("b") <= BROADCAST_BYTES)).agg(F.min("df")).first()[0]
    rest = known if fits is None else known.where(F.col("df") < fits)
    met = bag if fits is None else bag.join(F.broadcast(known.where(F.col("df") >= fits)), "term", "left")
    if fits is None or not rest.isEmpty():
        open_ = met if fits is None else met.where(F.col("df").isNull()).drop("df")
        found = open_.join(rest, "term", "left")
        met = found if fits is None else met.where(F.col("df").isNotNull()).unionByName(found)
    raw = met.withColumn("w", F.col("tf") * (F.ln((1 + n_docs) / (1 + F.coalesce("df", F.lit(1)))) + 1))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
    return raw.select(doc, "term", "tf", (F.col("w") / length).alias("tfidf"))


def naive_bayes(train: DataFrame, target: DataFrame, doc: str, label: str, classes: Sequence,
                smoothing: float = 1.0, train_docs: DataFrame | None = None, target_docs: DataFrame | None = None) -> DataFrame:
    """Multinomial naive Bayes: log score per class and the best class.

    ``train`` is a labelled bag (doc, label, term, tf), ``target`` a bag
    (doc, term, tf).  Terms unknown to the training bag are ignored; a tie goes
    to the first class.  ``classes`` is the short list of labels.  The fitted
    table, one row per term, is written once and read for totals and scores.

    A bag does not hold documents without terms.  ``train_docs`` (doc, label) and
    ``target_docs`` (doc) list all documents, one row each: the shares of the classes are
    then counted over the first, and every document of the second gets a row,
    scored by those shares alone if it holds no known term.
    """
    ensure_checkpoint_dir(train.sparkSession)
    n_c = [F.sum(F.when(F.col(label) == k, F.col("tf")).otherwise(0)).alias(f"n{i}") for i, k in enumerate(classes)]
    terms = train.groupBy("term").agg(*n_c).checkpoint()
    totals = terms.agg(F.struct(F.count(F.lit(1)).alias("v"), *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(classes))])).scalar()
    listed = train.select(doc, label).distinct() if train_docs is None else train_docs.select(doc, label)
    docs = listed.agg(F.struct(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(label) == k).alias(f"d{i}") for i, k in enumerate(classes)])).scalar()
    known = target.join(terms, "term").withColumn("tot", totals)
    scores = known.groupBy(doc).agg(*[
        F.sum(F.col("tf") * (F.ln(F.col(f"n{i}") + smoothing) - F.ln(F.col(f"tot.n{i}") + smoothing * F.col("tot.v")))).alias(f"s{i}")
        for i in range(len(classes))])
    if target_docs is not None:
        scores = target_docs.select(doc).join(scores, doc, "left")
    scores = scores.withColumn("p", docs)
    out = scores.withColumns({f"score_{k}": F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + F.ln(F.col(f"p.d{i}") / F.col("p.n")) for i, k in enumerate(classes)})
    best = F.greatest(*[F.col(f"score_{k}") for k in classes])
    choice = F.lit(None)
    for k in reversed(list(classes)):
        choice = F.when(F.col(f"score_{k}") == best, F.lit(k)).otherwise(choice)
    return out.select(doc, *[f"score_{k}" for k in classes], choice.alias("prediction"))


def text_pipeline(train: DataFrame, target: DataFrame, doc: str, label: str, classes: Sequence, analyse: Callable[[Column], Column],
                  smoothing: float = 1.0) -> DataFrame:
    """Bag of words, tf-idf and naive Bayes, fitted on ``train`` and applied to ``target``.

    ``train`` is (doc, label, text), ``target`` is (doc, text), one row per
    document.  ``analyse`` makes the array of words of a text.  Document
    frequencies come from ``train``; the weights of a document are scaled to
    length 1 over the terms known from there.  All terms count: the vocabulary
    stays a table.  Every document of ``target`` gets a row.
    """
    bags = [bag_of_words(df, doc, analyse(F.col("text"))) for df in (train, target.select(doc, "text"))]
    ensure_checkpoint_dir(train.sparkSession)
    known = bags[0].groupBy("term").agg(F.count(F.lit(1)).alias("df")).checkpoint()
    n_docs = train.agg(F.count(F.lit(1))).scalar()
    weighed = []
    for rows in bags:
        w = rows.join(known, "term").withColumn("w", F.col("tf") * (F.ln((1 + n_docs) / (1 + F.col("df"))) + 1))
        length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
        weighed.append(w.withColumn("tf", F.col("w") / length).drop("w", "df"))
    return naive_bayes(*weighed, doc, label, classes, smoothing, train.select(doc, label), target.select(doc))
