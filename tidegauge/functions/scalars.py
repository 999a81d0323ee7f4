"""Scalar cleaning, date and flag expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidegauge.functions.rolling import _c

EPSILON = 1e-15


def percent_text(x) -> Column:
    """``"45.2%"`` -> 45.2; blank or unreadable -> NULL."""
    return F.regexp_replace(F.trim(_c(x)), "%", "").try_cast("double")


def grouped_number(x, kind="double") -> Column:
    """``"1,234.5"`` -> 1234.5; ``kind='bigint'`` for whole counts."""
    return F.regexp_replace(F.trim(_c(x)), ",", "").try_cast(kind)


def dashed_number(x) -> Column:
    """A number where a lone dash or a blank means missing."""
    text = F.nullif(F.trim(_c(x)), F.lit("-"))
    return F.regexp_replace(text, ",", "").try_cast("double")


def date_text(x, pattern="yyyy-MM-dd") -> Column:
    """Date by a fixed pattern; unreadable -> NULL."""
    return F.try_to_timestamp(_c(x), F.lit(pattern)).cast("date")


def month_end(d, n=0) -> Column:
    """n=0: end of this month. n=1: the next month end strictly after d."""
    d = _c(d)
    if n == 0:
        return F.last_day(d)
    out = d
    for _ in range(n):
        out = F.last_day(F.date_add(out, 1))
    return out


def quarter_label(d) -> Column:
    d = _c(d)
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def put_call_ratio(ratio, put, call) -> Column:
    """The given ratio, else put/call where calls are positive."""
    return F.coalesce(_c(ratio), F.when(_c(call) > 0, F.try_divide(_c(put), _c(call))))


def member_list(x) -> Column:
    """``"A,B,A"`` -> [A, B]."""
    return F.array_distinct(F.split(_c(x), ","))


def table_label(x) -> Column:
    """A theme title as a table name: number prefix and bracketed words dropped."""
    s = F.regexp_replace(F.lower(_c(x)), r"^\d+\.?\s*_?\s*", "")
    s = F.replace(s, F.lit("s&p 500"), F.lit("sandp500"))
    s = F.regexp_replace(s, r"\(.*?\)", "")
    s = F.regexp_replace(s, r"[^a-z0-9]+", "_")
    return F.concat(F.lit("theme_"), F.btrim(s, F.lit("_")))


def side(a, b) -> Column:
    """-1, 0 or 1 as a is below, at or above b; NULL when either is missing."""
    return F.signum(_c(a) - _c(b)).cast("int")


def band(x, cuts=(20, 40)) -> Column:
    """Index of the half-open band [.., c0), [c0, c1), [c1, ..); NULL stays NULL."""
    x = _c(x)
    out = F.when(x < cuts[0], 0)
    for i, cut in enumerate(cuts[1:], start=1):
        out = out.when(x < cut, i)
    return out.when(x.isNotNull(), len(cuts))


def flag(condition: Column) -> Column:
    """1 or 0; an undecided comparison (NULL) counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def clip(x, low=EPSILON, high=1 - EPSILON) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(x)))


def logit(p, epsilon=EPSILON) -> Column:
    p = clip(p, epsilon, 1 - epsilon)
    return F.ln(p / (1 - p))


def inverse_logit(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def finite(x) -> Column:
    """NaN and both infinities become NULL."""
    x = _c(x).cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def days_between(later, earlier) -> Column:
    return F.datediff(_c(later), _c(earlier))


def digamma(x) -> Column:
    """Logarithmic derivative of the gamma function, for positive x: the asymptotic series eight steps on."""
    x = F.col(x) if isinstance(x, str) else x
    y = x + F.lit(8.0)
    series = F.ln(y) - 1 / (2 * y) - 1 / (12 * y ** 2) + 1 / (120 * y ** 4) - 1 / (252 * y ** 6) + 1 / (240 * y ** 8)
    return series - sum((1 / (x + F.lit(float(i))) for i in range(1, 8)), 1 / x)
