"""Fill-in-middle transformation, in DataFrame operations only.

A text is an array of units, each a word with the white space before it. Two cuts among the units, taken from a hash of
the seed and the document's id, divide it into prefix, middle and suffix, which are then told in another order behind
sentinels, so that a model that reads from left to right learns to fill the middle. Which documents are
rearranged, and in which of two orders, follows from the same hash: nothing depends on the order of rows or on the number
of partitions, and a task that runs anew gives the same output.

The work of a row stays in the row: no shuffle, no state, one scan of ``doc_id`` and ``text`` and what else is asked for.

Defined cases: a null text is the empty text, and the empty text stays as it is; so does a text that holds a sentinel
already, whose form is told as plain. A null ``doc_id`` is hashed as the empty word. White space at the end is a unit of
its own. With one unit, one or two of the three parts are empty. Repeated rows are transformed alike; other columns are
kept whatever their names, unless the result has a column of that name, which then takes its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"


def _draw(digest: Column, i: int) -> Column:
    """The i-th group of eight digits of a hash, as a number."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def _any_of(sentinels: tuple[str, str, str]) -> str:
    return "|".join(rf"\Q{s}\E" for s in sentinels)


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Sentinels of which no two can overlap, so that those of an output are found wherever the texts are cut."""
    ends = [(a, b, n) for a in sentinels for b in sentinels for n in range(1, min(len(a), len(b)) + (a != b))]
    held = any(a != b and a in b for a in sentinels for b in sentinels)
    if not all(sentinels) or len(set(sentinels)) < 3 or held or any(a.endswith(b[:n]) for a, b, n in ends) or any("\\E" in s for s in sentinels):
        raise ValueError("sentinels must be three different words of which none holds another or ends as another begins")
    return sentinels


def transform(
    docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars and output.

    rate: percent of the documents that are rearranged; spm_rate: percent of those in the order suffix, prefix, middle.
    sentinels: those of the prefix, the suffix and the middle.
    """
    p, s, m = _checked(sentinels)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit(""))), 256)
    made = {"n", "form", "prefix_chars", "middle_chars", "output"}
    names = [c for c in docs.columns if c not in made]
    kept = [docs[f"`{c}`"].alias(f"k{i}") for i, c in enumerate(names)]
    rows = docs.select(*kept, F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), digest.alias("digest"))
    rows = rows.withColumn("units", F.regexp_extract_all("text", F.lit(UNITS), 0))
    rows = rows.withColumns({"n": F.size("units").cast("long"), "h1": _draw(F.col("digest"), 0), "h2": _draw(F.col("digest"), 1)})
    ends = [F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)]
    form = F.when(
        (F.col("text") == "") | F.col("text").rlike(_any_of(sentinels)) | (_draw(F.col("digest"), 2) % 100 >= rate), PLAIN
    ).when(_draw(F.col("digest"), 3) % 100 < spm_rate, SPM).otherwise(PSM)
    rows = rows.withColumns({"a": F.least(*ends).cast("int"), "b": F.greatest(*ends).cast("int"), "form": form})
    moved = F.col("form") != PLAIN

    def part(begin: Column, count: Column) -> Column:
        return F.when(moved, F.array_join(F.slice("units", begin + 1, count), ""))

    rows = rows.withColumns(
        {"prefix": part(F.lit(0), F.col("a")), "middle": part(F.col("a"), F.col("b") - F.col("a")), "suffix": part(F.col("b"), F.col("n").cast("int"))}
    )
    output = F.when(
        F.col("form") == PSM, F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle")
    ).when(F.col("form") == SPM, F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle")).otherwise(F.col("text"))
    return rows.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "n", "form", F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"), output.alias("output")
    )


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text before the transformation, from its output and form alone: sentinels tell the parts, which are put in order."""
    parts = F.array(F.split(output, _any_of(_checked(sentinels)), -1))  # before the first sentinel stands nothing

    def joined(*order: int) -> Column:
        return F.transform(parts, lambda x: F.concat(*[x[i] for i in order]))[0]  # the output is split once

    return F.when(form == PSM, joined(1, 3, 2)).when(form == SPM, joined(2, 3, 1)).otherwise(output)
