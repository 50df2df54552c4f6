"""Scalar helpers shared by the operators. Everything here returns Columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_date(as_of: dt.date | str) -> Column:
    return F.lit(str(as_of)).cast("date")


def day_start(as_of: dt.date | str, days_before: int = 0) -> Column:
    """Midnight of ``as_of`` minus ``days_before`` days, as a timestamp without zone."""
    day = dt.date.fromisoformat(str(as_of)) - dt.timedelta(days=days_before)
    return F.lit(f"{day} 00:00:00").cast("timestamp_ntz")


def days_between(start: str | Column, end: str | Column) -> Column:
    return F.datediff(col(end), col(start))


def is_blank(c: str | Column) -> Column:
    return col(c).isNull() | (F.trim(col(c)) == "")


def contains_any(lowered: Column, words: Sequence[str]) -> Column:
    """True when the lower-cased text holds one of ``words``.

    A word that contains another word of the list adds nothing and is left out.
    """
    words = [w.lower() for w in words]
    needed = [w for w in dict.fromkeys(words) if not any(o != w and o in w for o in words)]
    hit = F.lit(False)
    for word in needed:
        hit = hit | lowered.contains(word)
    return hit


def map_value(c: str | Column, mapping: Mapping, default=None) -> Column:
    """Simple CASE: the mapped literal for each key, ``default`` otherwise."""
    out = None
    for key, value in mapping.items():
        value = value if isinstance(value, Column) else F.lit(value)
        cond = col(c) == F.lit(key)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    if out is None:
        return F.lit(default)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def label_ranges(branches: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """Searched CASE over labelled conditions, first match wins."""
    out = None
    for cond, label in branches:
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def known_or(c: str | Column, allowed: Iterable[str], default: str) -> Column:
    """The value when it belongs to the enumeration, the default otherwise (also for NULL)."""
    return F.when(col(c).isin(*allowed), col(c)).otherwise(F.lit(default))


def or_zero(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(0))


def count_flags(conditions: Iterable[Column]) -> Column:
    total = F.lit(0)
    for cond in conditions:
        total = total + F.when(cond, 1).otherwise(0)
    return total


def exact_avg(c: Column) -> Column:
    """Aggregate: mean of a double whose result does not depend on the row order.

    The sum runs over fixed-point values, so partial sums from different tasks
    combine without rounding.
    """
    return F.sum(c.cast("decimal(18,12)")).cast("double") / F.count(c)


def number_text(c: Column, digits: int) -> Column:
    """A double rounded to ``digits`` (halves away from zero) and printed without trailing zeros."""
    text = F.round(c.cast("decimal(18,12)"), digits).cast(f"decimal(18,{digits})").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "") if digits else text


def int_text(c: Column) -> Column:
    return c.cast("bigint").cast("string")


def money_text(c: Column) -> Column:
    return c.cast("decimal(18,2)").cast("string")


def stable_id(prefix: str, *keys: str | Column) -> Column:
    """``prefix`` + the 64 upper-case hex digits of a digest of the keys; a replay gives the same id."""
    joined = F.concat_ws("␟", *[F.coalesce(col(k).cast("string"), F.lit("")) for k in keys])
    return F.concat(F.lit(prefix), F.upper(F.sha2(joined, 256)))


def numbered_id(prefix: str, n: Column, width: int = 5) -> Column:
    """``NBA00042``; wider numbers keep all their digits."""
    return F.format_string(f"{prefix}%0{width}d", n)


def id_number(c: str | Column, prefix: str) -> Column:
    return F.try_to_number(F.replace(col(c), F.lit(prefix), F.lit("")), F.lit("9" * 18)).cast("bigint")


def thousands(c: str | Column, digits: int = 0) -> Column:
    return F.format_number(col(c), digits)


def percent(c: str | Column) -> Column:
    """A share printed as whole percent; halves round to the even neighbour."""
    return F.format_string("%d%%", F.bround(col(c) * 100, 0).cast("int"))


def multi_filter(df: DataFrame, selections: Mapping[str, Sequence]) -> DataFrame:
    """Keep the selected values of each column; an empty selection keeps everything."""
    for name, values in selections.items():
        if values:
            df = df.filter(F.col(name).isin(*values))
    return df


def split_items(c: str | Column, separator: str = " | ") -> Column:
    """Array of the non-blank, trimmed items of a joined text."""
    parts = F.split(col(c), F.lit("\\Q" + separator + "\\E"))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
