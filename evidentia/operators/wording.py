"""Wording of texts: sentences, casing, spacing, required terms, near copies of names, values in the last object of a text.

Defined cases: null texts are empty; a word that the model has not seen keeps its form; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.novelty import sentences


def sentence_figures(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """id, sentences, longest, questions of each text with a sentence."""
    s = sentences(docs, id_, text)
    return s.groupBy("id").agg(
        F.count(F.lit(1)).alias("sentences"), F.max(F.length("sentence")).alias("longest"), F.sum(F.col("sentence").endswith("?").cast("long")).alias("questions")
    )


def _spaced(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def casing(docs: DataFrame, text: str) -> DataFrame:
    """lower, form: how each word is mostly written inside sentences, where no capital is due; of equal forms the lesser.

    Words are counted by form before anything meets; the first word of a text and those after . ! ? don't count.
    """
    w = F.col("_w")
    inside = F.filter(
        F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.when(~F.get(w, i - 1).rlike(r"[.!?]$"), F.regexp_replace(F.get(w, i), r"[.,!?;:]+$", ""))),
        lambda x: x.isNotNull() & (x != "")
    )
    rows = docs.select(_spaced(F.col(text)).alias("_w")).filter(F.size("_w") > 1).select(F.explode(inside).alias("form"))
    counts = rows.groupBy("form").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(F.lower("form").alias("lower")).agg(F.min_by("form", F.struct(-F.col("n"), "form")).alias("form"))


def cased(docs: DataFrame, id_: str, text: str, model: DataFrame) -> DataFrame:
    """id, text: lower-cased words in their usual form, and a capital where a sentence begins. Words meet the model by equality."""
    words = docs.select(F.col(id_).alias("id"), F.posexplode(_spaced(F.lower(F.col(text)))).alias("at", "w"), _spaced(F.col(text)).alias("_w"))
    parts = words.select(
        "id", "at", F.regexp_replace("w", r"[.,!?;:]+$", "").alias("lower"), F.regexp_extract("w", r"[.,!?;:]+$", 0).alias("tail"),
        ((F.col("at") == 0) | F.get("_w", F.col("at") - 1).rlike(r"[.!?]$")).alias("first")
    )
    form = F.coalesce("form", "lower")
    form = F.when(F.col("first"), F.concat(F.upper(F.substring(form, 1, 1)), F.substring(form, 2, 1_000_000_000))).otherwise(form)
    met = parts.join(model, "lower", "left").select("id", "at", F.concat(form, "tail").alias("w"))
    return met.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]), " ").alias("text"))


def closed_up(text: Column) -> Column:
    """Tokens as written text: no space before closing marks and after opening ones, one between words."""
    out = F.regexp_replace(F.btrim(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " ")
    out = F.regexp_replace(out, r" ([.,!?;:%)\]}])", "$1")
    return F.regexp_replace(out, r"([(\[{]) ", "$1")


def missing_terms(pairs: DataFrame, id_: str, source: str, target: str, glossary: DataFrame) -> DataFrame:
    """id, term, wanted: glossary terms (term, wanted; single lower-case words) that a source has and whose wanted word its target lacks."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0))
    had = pairs.select(F.col(id_).alias("id"), words(target).alias("_t"), F.explode(words(source)).alias("term"))
    return had.join(glossary, "term").filter(~F.array_contains("_t", F.col("wanted"))).select("id", "term", "wanted")


def last_object(text: Column) -> Column:
    """The last flat object in braces of a text, null if there is none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\{[^{}]*\}"), 0)
    return F.get(found, F.size(found) - 1)


def near_names(names: DataFrame, known: DataFrame, most: int = 1) -> DataFrame:
    """id, name, known, edits: known names at most ``most`` edits away. Both sides meet by their variants without up to ``most`` characters.

    Two names so near share such a variant, so no pair of names is compared that shares none; long variants are compared by hash.
    """

    def variants(c: str) -> Column:
        out = F.array(F.col(c))
        for _ in range(most):
            shorter = F.flatten(
                F.transform(
                    out, lambda s: F.transform(
                        F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))
                    )
                )
            )
            out = F.array_distinct(F.concat(out, shorter))
        return out

    a = names.filter(F.col("name").isNotNull()).select("id", "name", F.explode(variants("name")).alias("_v"))
    b = known.filter(F.col("known").isNotNull()).select("known").distinct().select("known", F.explode(variants("known")).alias("_v"))
    met = a.join(b, "_v").select("id", "name", "known").distinct()
    return met.withColumn("edits", F.levenshtein("name", "known")).filter(F.col("edits") <= most)
