"""Scalar expressions with the text semantics of chat histories: all Unicode white space counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points that count as white space.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{WS}|{WS}$", "")


def is_blank(x: Column) -> Column:
    return F.length(strip(x)) == 0


def words(x: Column) -> Column:
    """White-space separated words; none for a blank text."""
    return F.filter(F.split(x, WS), lambda w: w != "")


def title(x: Column, limit: int = 44) -> Column:
    """One line of at most limit characters, cut with three dots."""
    one = F.regexp_replace(F.regexp_replace(x, WS, " "), "^ | $", "")
    return F.when(F.length(one) <= limit, one).otherwise(F.concat(F.rtrim(F.substring(one, 1, limit - 3)), F.lit("...")))


def without_slashes(x: Column) -> Column:
    return F.regexp_replace(x, "/+$", "")


def or_default(x: Column, default: str) -> Column:
    """The default where x is absent or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def from_iso(x: Column) -> Column:
    return F.to_timestamp(x)


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def log_line(ts: Column, message: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("] "), message)


_DIGITS = "[0-9](?:_?[0-9])*"
#: What a text must be to be read as a number, without the white space around it; digits may be grouped by single underscores.
NUMBER = rf"(?i)^[+-]?(?:inf|infinity|nan|(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?)$"
WHOLE = f"^[+-]?{_DIGITS}$"


def number(x: Column) -> Column:
    """The number that a text is, null if it is none: a grammar decides, as casts read `30d` too, and no `1_000`."""
    text = strip(x)
    return F.when(text.rlike(NUMBER), F.replace(text, F.lit("_")).try_cast("double"))


def whole_number(x: Column) -> Column:
    """The whole number that a text is, of up to 38 digits; null if it is none."""
    text = strip(x)
    return F.when(text.rlike(WHOLE), F.replace(text, F.lit("_")).try_cast("decimal(38,0)"))


def positive(n: Column) -> Column:
    """A number if it is above 0 (or not a number); null otherwise."""
    return F.when(n > 0, n)


def bounded(n: Column, least: float, most: float) -> Column:
    return F.when(n.between(least, most), n)


def job_port(job: Column) -> Column:
    return F.lit(60000) + job % 4000


def before_semicolon(x: Column) -> Column:
    return F.substring_index(x, ";", 1)


def whole(x: Column) -> Column:
    """Whether a text is a number without sign."""
    return F.coalesce(x.rlike("^[0-9]+$"), F.lit(False))


def positive_whole(x: Column) -> Column:
    return F.coalesce(x.rlike("^[1-9][0-9]*$"), F.lit(False))


def flag(x: Column) -> Column:
    return F.coalesce(x.isin("0", "1"), F.lit(False))


def port(x: Column) -> Column:
    """Whether a text is a port that needs no privilege."""
    return whole(x) & F.coalesce(x.try_cast("long").between(1024, 65535), F.lit(False))


def needs_key(host: Column, key: Column) -> Column:
    """Whether a server that others can reach has no key."""
    return ~host.isin("127.0.0.1", "localhost") & (F.coalesce(key, F.lit("")) == "")


def enough_memory(least: Column, wanted: Column) -> Column:
    return least >= wanted


def present(values: Column, *names: str, default: str | None = None) -> Column:
    """The first of these names that a map holds (an empty text is held), else the default."""
    return F.coalesce(*(values[n] for n in names), F.lit(default).cast("string"))
