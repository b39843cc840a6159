"""Line dedup by site-relative frequency, in DataFrame operations only.

For each host the pages that contain a line are counted, each page once however often it repeats the line, and
divided by the host's pages. Pages of one host with one and the same text count as one page, above and below
the line, so copies of a page never make its lines boilerplate. A line that exceeds the ratio, and stands on at
least ``min_pages`` such pages, is boilerplate of that host and is removed from its pages; other hosts keep it.

Lines are compared without spaces, tabs and carriage returns around them, by a 64-bit hash. Counts are summed
before the shuffle and dealt by host and line, so a host with a third of all pages is spread over all tasks.
A host's boilerplate has at most (lines of a mean page) / ratio entries, whatever the number of pages. Page
totals and boilerplate meet the lines and pages by host: broadcast while they are measured to be small, otherwise dealt by
host and a salt, so that no host is one task's.

Defined cases: a null text stays null, has no lines and all null texts of a host count as one page; a null host
is the empty host; blank lines are neither counted nor removed; repeated rows count as one page and lose the
same lines; a text all of whose lines go becomes empty; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm._shared import join_small, settle

_BLANKS = " \t\r"


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(_BLANKS)))


def _filled(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS)) != ""


def boilerplate(pages: DataFrame, text: Column, host: Column, ratio: tuple[int, int], min_pages: int) -> DataFrame:
    """``host``, ``drop``: the hashes of each host's boilerplate lines."""
    base = pages.select(F.coalesce(host.cast("string"), F.lit("")).alias("host"), text.alias("text"))
    hashed = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), _filled), _key))
    # One row a distinct text of a host, with the hashes of its lines: much less than the text.
    own = settle(base.groupBy("host", F.xxhash64("text").alias("page")).agg(F.first(hashed).alias("lines")), "page-lines")
    total = settle(own.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts")
    size = total.agg(F.sum(F.octet_length("host") + 16)).first()[0] or 0
    lines = own.select("host", F.explode("lines").alias("line"))
    found = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    over = join_small(found, total, "host", F.col("line"), size, "inner").filter(F.col("n") * ratio[1] > F.col("pages") * ratio[0])
    return over.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("drop"))


def remove_boilerplate(
    pages: DataFrame, text: str = "text", host: Column | str = "source", ratio: tuple[int, int] = (1, 10), min_pages: int = 3, counts: bool = False
) -> DataFrame:
    """``pages`` with ``text`` without boilerplate; all other columns stay.

    ratio: numerator and denominator. min_pages: on fewer distinct pages of a host no line is boilerplate, however
    small the host. counts: also add ``n_lines`` and ``n_dropped`` (replacing columns of these names).
    """
    text_col, host_col = pages[text], pages[host] if isinstance(host, str) else host
    lists = settle(boilerplate(pages, text_col, host_col, ratio, min_pages), "boilerplate")
    size = lists.agg(F.sum(F.octet_length("host") + 8 * F.size("drop") + 16)).first()[0] or 0
    # Own names for the helper columns, whatever the table has.
    names = [f"__{n}" for n in ("host", "drop", "lines", "kept")]
    while set(names) & set(pages.columns):
        names = [f"_{n}" for n in names]
    h, d, ls, kept = names
    named = pages.withColumns({h: F.coalesce(host_col.cast("string"), F.lit("")), ls: F.split(text_col, "\n")})
    joined = join_small(named, lists.select(F.col("host").alias(h), F.col("drop").alias(d)), h, F.xxhash64(text_col), size, "left")
    keep = F.when(F.col(d).isNull(), F.col(ls)).otherwise(F.filter(ls, lambda x: ~(_filled(x) & F.array_contains(F.col(d), _key(x)))))
    out = joined.withColumn(kept, keep)
    extra = {
        "n_lines": F.coalesce(F.size(ls), F.lit(0)).cast("long"), "n_dropped": F.coalesce(F.size(ls) - F.size(kept), F.lit(0)).cast("long")
    } if counts else {}
    columns = [F.array_join(kept, "\n").alias(text) if c == text else F.col(f"`{c}`") for c in pages.columns if c not in extra]
    return out.select(*columns, *[v.alias(k) for k, v in extra.items()])


def with_length(docs: DataFrame) -> DataFrame:
    """``n_chars``, if there is such a column, set to the length of ``text``."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs
