"""Times as whole microseconds, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{ts}`)")


def seconds(ts: str) -> Column:
    return micros(ts) / F.lit(1e6)


def iso(us: Column) -> Column:
    """ISO text in UTC of microseconds since 1970."""
    whole = F.floor(us / 1_000_000)
    day, rest = F.floor(whole / 86_400), F.pmod(whole, F.lit(86_400))
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")), "yyyy-MM-dd")
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(
        date, F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.pmod(F.floor(rest / 60), F.lit(60))), F.lit(":"), two(F.pmod(rest, F.lit(60))),
        F.lit("Z")
    )


def epoch_of(text: Column) -> Column:
    """Microseconds since 1970 of an ISO text in UTC; null if it is none."""
    plain = F.regexp_replace(F.regexp_replace(text, "T", " "), "Z$", "").try_cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), plain)


def run_name(us: Column, label: str = "") -> Column:
    """A stamp in UTC that sorts by time, with a label of plain letters."""
    stamp = F.regexp_replace(F.regexp_replace(iso(us), "[-:]", ""), "T", "-")
    plain = "".join(c if c.isalnum() else "-" for c in label.lower()).strip("-")
    return F.concat(stamp, F.lit(f"-{plain}")) if plain else stamp
