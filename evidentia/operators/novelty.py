"""What is new in a document: sparse TF-IDF neighbours by an equality join on terms, and gram containment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import content_words, grams, words


def terms(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """id, term, tf of content words. Documents are dealt by id as arrays of words, so that what is grouped by id later on is where it must be."""
    dealt = docs.select(F.col(id_).alias("id"), content_words(F.col(text)).alias("_w")).repartition("id")
    # A slice, not the column: of a column Spark finds the words twice, for it filters empty arrays first.
    return dealt.select("id", F.explode(F.slice("_w", 1, F.size("_w"))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def weights(own: DataFrame, corpus: DataFrame) -> DataFrame:
    """id, term, w: unit-length vectors of (1 + ln tf) by the corpus's smoothed idf; unseen terms get the greatest."""
    n = corpus.agg(F.countDistinct("id").alias("n"))
    df = corpus.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = own.join(df, "term", "left").join(F.broadcast(n)).select(
        "id", "term", ((1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.coalesce("df", F.lit(0)))) + 1)).alias("w")
    )
    length = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("length"))
    return raw.join(length, "id").select("id", "term", (F.col("w") / F.col("length")).alias("w"))


def similar(queries: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """id, other, cosine, place: the k most alike of the corpus for each query (both: id, term, w); ties go to the lesser id."""
    met = queries.join(
        corpus.select(F.col("id").alias("other"), "term", F.col("w").alias("w2")), "term"
    ).groupBy("id", "other").agg(F.sum(F.col("w") * F.col("w2")).alias("cosine"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    return met.withColumn("place", place).filter(F.col("place") <= k)


def _exploded(rows: DataFrame, text: str, n: int, *keys: str) -> DataFrame:
    """keys, gram: 64-bit hashes of the distinct grams. The words are a column of their own, so that they are found once a row and not once a gram."""
    found = rows.select(*keys, words(F.col(text)).alias("_w")).select(*keys, F.explode(grams(F.col("_w"), n)).alias("gram"))
    return found.select(*keys, F.xxhash64("gram").alias("gram"))


def containment(docs: DataFrame, id_: str, text: str, corpus: DataFrame, corpus_text: str, n: int = 3) -> DataFrame:
    """id, grams, seen, contained: the share of a document's word grams that the corpus has."""
    known = _exploded(corpus, corpus_text, n).distinct().withColumn("known", F.lit(1))
    met = _exploded(docs.withColumn("id", F.col(id_)), text, n, "id").join(known, "gram", "left")
    total = met.groupBy("id").agg(F.count(F.lit(1)).alias("grams"), F.count("known").alias("seen"))
    return total.select("id", "grams", "seen", (F.col("seen") / F.col("grams")).alias("contained"))


def _pieces(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n"), lambda s: F.btrim(s)), lambda s: s != "")


def sentences(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """id, idx, sentence: pieces after . ! ? or at line ends, trimmed, without empty ones."""
    return docs.select(F.col(id_).alias("id"), F.posexplode(_pieces(F.col(text))).alias("idx", "sentence"))


#: How many grams are put in order at once.
AT_ONCE = 500_000


def _hashes(tokens: Column, n: int) -> Column:
    """64-bit hashes of the runs of n tokens, with repeats; a shorter list is one run."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0))), lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(n)]))
    return F.when(F.size(tokens) > 0, runs).otherwise(F.array().cast("array<long>"))


def _first_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, idx, gram, grams: each gram of a document where it is first, and for each sentence a row without gram that has the number of its grams."""
    for b in batches:
        ids, docs = b.column(0), b.column(1)
        to = docs.offsets.to_numpy()
        inner = docs.values.offsets.to_numpy()
        row = 0
        while row < len(ids):
            end = max(int(np.searchsorted(inner[to], inner[to[row]] + AT_ONCE, side="right")) - 1, row + 1)
            s0, s1 = to[row], to[end]
            gram = docs.values.values.to_numpy()[inner[s0] : inner[s1]]
            sentence = np.repeat(np.arange(s1 - s0), np.diff(inner[s0 : s1 + 1]))
            doc, idx = np.repeat(np.arange(row, end), np.diff(to[row : end + 1])), np.arange(s0, s1) - np.repeat(to[row:end], np.diff(to[row : end + 1]))
            order = np.lexsort((sentence, gram))
            gram, sentence = gram[order], sentence[order]
            other = np.r_[True, gram[1:] != gram[:-1]][: len(gram)]
            total = np.bincount(sentence[other | np.r_[True, sentence[1:] != sentence[:-1]][: len(gram)]], minlength=s1 - s0)
            first = np.flatnonzero(other | np.r_[True, np.diff(doc[sentence]) != 0][: len(gram)])
            full = np.flatnonzero(total)
            at = np.r_[sentence[first], full]
            blank = np.arange(len(at)) >= len(first)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(doc[at])), pa.array(idx[at].astype(np.int32)), pa.array(np.r_[gram[first], np.zeros(len(full), np.int64)], mask=blank),
                    pa.array(np.r_[np.zeros(len(first), np.int64), total[full]], mask=~blank)
                ],
                ["id", "idx", "gram", "grams"]
            )
            row = end


def new_sentences(docs: DataFrame, id_: str, text: str, corpus: DataFrame, corpus_text: str, n: int = 3, tau: float = 0.5) -> DataFrame:
    """id, idx, grams, fresh, score, novel: the share of a sentence's grams that neither the corpus nor an earlier sentence has.

    A document is a row (``id_`` is a key), so its grams are found once, and where they are first in the row's own task; only sentences are shuffled.
    """
    tokens = F.transform(_pieces(F.col(text)), lambda s: words(s))  # Words first: a lambda would find them again for each gram.
    own = docs.select(F.col(id_).alias("id"), F.transform(tokens, lambda w: _hashes(w, n)).alias("_g"))
    first = own.mapInArrow(_first_grams, f"id {dict(own.dtypes)['id']}, idx int, gram long, grams long")
    known = corpus.select(words(F.col(corpus_text)).alias("_w")).select(F.explode(_hashes(F.col("_w"), n)).alias("gram")).distinct()
    fresh, grams = F.count("gram"), F.sum("grams")
    score = F.col("fresh") / F.col("grams")
    return first.join(known, "gram", "left_anti").groupBy("id", "idx").agg(grams.alias("grams"), fresh.alias("fresh")).select(
        "id", "idx", "grams", "fresh", score.alias("score"), (score > tau).alias("novel")
    )


def rank(scored: DataFrame, tau: float = 0.5) -> DataFrame:
    """id, added, novel_sentences: documents by what they add, most first (from ``new_sentences``)."""
    return scored.groupBy("id").agg(
        F.sum(F.col("grams") * F.greatest(F.col("score") - tau, F.lit(0.0))).alias("added"),
        F.sum(F.col("novel").cast("int")).alias("novel_sentences")
    ).orderBy(F.desc("added"), F.desc("novel_sentences"), "id")


def calibrated(scored: DataFrame, share: float = 0.9, least: float = 0.5) -> DataFrame:
    """One row: the threshold that this share of a baseline's sentences (from ``new_sentences``) stays under, ``least`` at least."""
    return scored.agg(F.greatest(F.coalesce(F.percentile("score", share), F.lit(0.0)), F.lit(least)).alias("tau"))


def verdicts(scored: DataFrame, threshold: DataFrame, few: int = 3) -> DataFrame:
    """id, sentences, novel, share, verdict of documents, by a threshold of one row."""
    per = scored.join(F.broadcast(threshold)).groupBy("id").agg(
        F.count(F.lit(1)).alias("sentences"), F.sum((F.col("score") > F.col("tau")).cast("long")).alias("novel")
    )
    share = F.col("novel") / F.col("sentences")
    word = F.when(F.col("sentences") < few, "too short").when(share >= 0.5, "new").when(F.col("novel") > 0, "partly new").otherwise("known")
    return per.select("id", "sentences", "novel", share.alias("share"), word.alias("verdict"))
