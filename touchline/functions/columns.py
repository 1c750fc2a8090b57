"""Scalar column helpers where Spark's own functions differ from the semantics wanted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slugify(*parts: Column | str) -> Column:
    """Lower-case text with runs of white space as hyphens, followed by the other parts.

    The pattern replaces white space, which is what a slug is for; nulls are skipped.
    """
    first, *rest = map(_col, parts)
    return F.concat_ws("-", F.lower(F.regexp_replace(first, r"\s+", "-")), *[c.cast("string") for c in rest])


def title_words(name: Column | str) -> Column:
    """Each run of letters and digits with a capital first and the rest small; null stays null.

    Unlike ``initcap``, which starts words only after blanks, any other sign starts one.
    """
    parts = F.split(F.lower(_col(name)), r"(?<=[^\p{L}\p{N}])")
    words = F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.array_join(words, "")


def pair_key(a: Column | str, b: Column | str) -> Column:
    """Key of an unordered pair: the smaller number, an underscore, the larger one."""
    return F.concat_ws("_", F.least(_col(a), _col(b)), F.greatest(_col(a), _col(b)))


def round_ratio(num: Column | str, den: Column | str, digits: int) -> Column:
    """num / den, non-negative whole numbers, rounded half up by exact integer arithmetic.

    Null for a null side or a zero denominator.
    """
    n, d, scale = _col(num).cast("long"), _col(den).cast("long"), 10**digits
    safe = F.when(d != 0, d)
    doubled = n * F.lit(2 * scale) + safe
    whole = (doubled - F.pmod(doubled, safe * 2)) / (safe * 2)
    return whole / F.lit(float(scale))


def array_text(values: Column | str) -> Column:
    """An array of plain words as ``{a,b,NULL}`` text."""
    return F.concat(F.lit("{"), F.array_join(_col(values), ",", "NULL"), F.lit("}"))


def safe_int(value: Column | str) -> Column:
    """Text as an int, null where it isn't one."""
    return _col(value).try_cast("int")


def utc_instant(text: Column | str) -> Column:
    """ISO-8601 text as an instant: without an offset it is UTC, with ``Z`` or an offset that counts.

    Null for anything else.
    """
    return _col(text).try_cast("timestamp")


def season_label(year: Column | str) -> Column:
    """``2024/25`` of 2024."""
    y = _col(year)
    return F.concat(y.cast("string"), F.lit("/"), F.lpad(F.pmod(y + 1, F.lit(100)).cast("string"), 2, "0"))


def result_of(mine: Column | str, theirs: Column | str) -> Column:
    """win, draw or loss by goals; null if either side is null."""
    a, b = _col(mine), _col(theirs)
    return F.when(a > b, "win").when(a == b, "draw").when(a < b, "loss")


def letter_of(result: Column | str) -> Column:
    """W, D or L of win, draw or loss; null of anything else."""
    r = _col(result)
    return F.when(r == "win", "W").when(r == "draw", "D").when(r == "loss", "L")


def iso_time(at: Column | str) -> Column:
    """An instant as UTC text for payloads."""
    return F.date_format(_col(at), "yyyy-MM-dd'T'HH:mm:ss")
