"""Missing values, numbers and bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.text import Text, _c

#: Words that stand for a missing value.
NA_TOKENS = ("", "na", "n/a", "nan", "none", "null", "not provided", "not specified", "unknown", "-")


def nullify(x: Text, na_tokens: Sequence[str] = NA_TOKENS) -> Column:
    """Null for blanks and missing-value words, whatever their case."""
    value = F.trim(_c(x))
    return F.when(~F.lower(value).isin(*na_tokens), value)


def present(x: Text) -> Column:
    return _c(x).isNotNull() & (F.trim(_c(x)) != "")


def first_present(*columns: Text, default: str | None = None) -> Column:
    """The first value that is neither null nor blank."""
    values = [F.when(present(c), _c(c)) for c in columns]
    return F.coalesce(*values, *([F.lit(default)] if default is not None else []))


def log10p1(x: Text) -> Column:
    return F.log10(_c(x) + 1)


def ratio(part: Text, whole: Text, scale: float = 1.0) -> Column:
    """``scale * part / whole``; null where the whole is 0."""
    return F.when(_c(whole) != 0, scale * _c(part) / _c(whole))


def percent(part: Text, whole: Text) -> Column:
    return ratio(part, whole, 100.0)


def density(count: Text, area: Text, per: float = 1000.0) -> Column:
    """Count per ``per`` units of area; null where the area is not positive."""
    return F.when(_c(area) > 0, per * _c(count) / _c(area))


def clamp(x: Text, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(x)))


def band(x: Text, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the first edge that the value is below; the last label beyond all; null stays null."""
    chain = F.when(_c(x).isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        chain = chain.when(_c(x) < edge, label)
    return chain.otherwise(labels[len(edges)])


def plausible(x: Text, low: float, high: float) -> Column:
    """Null for values outside the range."""
    return F.when(_c(x).between(low, high), _c(x))
