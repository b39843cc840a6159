"""Text as column expressions: words, grams, quantities, marks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+(?:[:.'’\-/][\p{L}\p{N}_]+)*"

# Function words; negations are kept as content.
STOP = tuple(
    "a an and are as at be been but by for from had has have he her his i in is it its of on or she that the their they this to was we were which will with you".split()
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def content_words(text: Column) -> Column:
    return F.filter(words(text), lambda w: ~w.isin(*STOP))


def grams(tokens: Column, n: int = 3) -> Column:
    """Distinct runs of n tokens; a shorter list is one run."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def fence_id(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 8)


def fence(text: Column) -> Column:
    tag = fence_id(text)
    return F.concat(F.lit("<evidence "), tag, F.lit(">\n"), F.coalesce(text, F.lit("")), F.lit("\n</evidence "), tag, F.lit(">"))


SUSPECT = r"(?i)\b(ignore|disregard|forget)\b.{0,40}\b(instruction|instructions|above|previous|prompt)\b|\byou are now\b|\bsystem prompt\b"
REDACTED = r"\[(?:redacted|removed|withheld)\]|█{2,}|\bX{4,}\b"


def suspect_lines(text: Column, most: int = 5) -> Column:
    """Lines that read like instructions to the reader, at most so many."""
    return F.slice(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(SUSPECT)), 1, most)


def suspect_count(text: Column) -> Column:
    """How many such lines there are."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(SUSPECT)))


def redaction_marks(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)" + REDACTED), 0)


def is_null_wording(text: Column) -> Column:
    return F.lower(F.btrim(F.coalesce(text, F.lit("")), F.lit(" .\t"))).isin(
        "", "-", "n/a", "na", "nil", "none", "not stated", "null", "unknown", "not known", "not given"
    )


def spaced(text: Column) -> Column:
    """The words of a text between single spaces, one before and one after."""
    return F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))


def found_in(value: Column, source: Column, source_spaced: Column | None = None) -> Column:
    """Whether the words of one text stand in a row in the other. Who asks for several values has the source ``spaced`` once, as a column of its own."""
    where = spaced(source) if source_spaced is None else source_spaced
    return (F.size(words(value)) > 0) & F.instr(where, spaced(value)).cast("boolean")


QUANTITY = r"(?<![\p{L}\p{N}_.])([0-9]+(?:\.[0-9]+)?) ?(km|m|kg|g|s|min|h|hz|khz|mhz|ghz|db|dbm|%)(?![\p{L}\p{N}_])"


def quantities(text: Column) -> Column:
    """Array of {value, half, unit}: a number, half a unit of its last place, and its unit."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(QUANTITY), 0)

    def parse(x: Column) -> Column:
        number, unit = F.regexp_extract(x, r"^([0-9.]+)", 1), F.regexp_extract(x, r"([a-z%]+)$", 1)
        places = F.length(F.regexp_extract(number, r"\.([0-9]+)", 1))
        return F.struct(number.cast("double").alias("value"), (F.lit(0.5) * F.pow(F.lit(10.0), -places)).alias("half"), unit.alias("unit"))

    return F.transform(found, parse)


def same_claim(a: Column, b: Column) -> Column:
    """Whether two quantities may be one: units agree and their rounding intervals overlap."""
    return (a["unit"] == b["unit"]) & (F.abs(a["value"] - b["value"]) < a["half"] + b["half"])


def field(text: Column, name: str) -> Column:
    """What follows ``name:`` up to the end of the clause, null if nothing does."""
    got = F.btrim(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?im)^[ \t]*{name}[ \t]*:[ \t]*([^\n;]*)", 1))
    return F.when(got != "", got)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def fixed(x: Column, digits: int) -> Column:
    """``x`` with decimal places as printf of C has it: the number that the double is, not its shortest decimal, is rounded, ties to even."""

    @F.pandas_udf("string")
    def show(values: pd.Series) -> pd.Series:
        return values.map(lambda v: f"{v:.{digits}f}", na_action="ignore")

    return F.when(F.isnan(x), "NaN").otherwise(show(x.cast("double")))


def hz_words(hz: Column) -> Column:
    """A frequency with its natural unit."""
    value, unit = hz, F.lit(" Hz")
    for scale, name in ((1e3, " kHz"), (1e6, " MHz"), (1e9, " GHz")):
        value, unit = F.when(hz >= scale, hz / scale).otherwise(value), F.when(hz >= scale, name).otherwise(unit)
    return F.concat(F.regexp_replace(fixed(value, 3), r"\.?0+$", ""), unit)


def seconds_words(s: Column) -> Column:
    value = F.when(s >= 3600, s / 3600).when(s >= 60, s / 60).when(s >= 1, s).otherwise(s * 1000)
    unit = F.when(s >= 3600, " h").when(s >= 60, " min").when(s >= 1, " s").otherwise(" ms")
    return F.concat(fixed(value, 1), unit)
