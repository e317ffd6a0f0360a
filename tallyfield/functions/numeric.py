"""Small Column expressions used across the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round_half(col, digits: int = 2) -> Column:
    """SQL ``round`` of a double as column stores compute it: scaled, rounded half away from zero, scaled back.

    The built-in ``round(x, d)`` works on the decimal text of x instead, and so differs where x times 10^d is a tie that x itself is not.
    Here ``rint`` rounds, without a decimal number for each value; it goes to the even neighbour on a tie, which is then moved outwards.
    """
    scale = float(10 ** digits)
    y = _c(col).cast("double") * F.lit(scale)
    whole = F.rint(y)
    inwards = ((y > 0) & (y - whole == 0.5)) | ((y < 0) & (y - whole == -0.5))
    # adding 0 turns a negative zero into a plain one
    return (F.when(inwards, whole + F.signum(y)).otherwise(whole) + F.lit(0.0)) / F.lit(scale)


def ratio(num, den) -> Column:
    """num / den as doubles, NULL where den is 0."""
    return _c(num).cast("double") / F.nullif(_c(den).cast("double"), F.lit(0.0))


def money_sum(col) -> Column:
    """Sum of amounts in decimals of 8 places: the same in any row order, and nothing is rounded to cents before the end.

    Sums of doubles differ in the last bits from run to run, and an average of a few amounts in cents sits
    on a rounding tie often enough for that to show.
    """
    return F.sum(_c(col).cast("double").cast("decimal(26,8)")).cast("double")


def pct_error(pred, actual) -> Column:
    """(pred - actual) / max(1, actual) in percent."""
    return (_c(pred) - _c(actual)) / F.greatest(F.lit(1.0), _c(actual)) * F.lit(100.0)


def hash_uniform(*parts) -> Column:
    """Uniform draw in [0, 1) from the md5 of the parts joined by ':'.

    Depends only on the parts, never on partitioning or row order, so a lost executor
    or a different cluster size gives the same draws.
    """
    text = F.concat_ws(":", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def qcut_bin(position, n, q: int) -> Column:
    """Equal-frequency bin 1..q of the 1-based position among n rows (quantile edges, not ntile)."""
    pos, n = _c(position).cast("bigint"), _c(n).cast("bigint")
    steps = F.floor(((pos - 1) * F.lit(q) + n - 2) / F.greatest(n - 1, F.lit(1).cast("bigint")))
    return F.when(n <= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), steps.cast("int"))).cast("int")


def decile_label(bin_col) -> Column:
    return F.concat(F.lit("D"), F.lpad(_c(bin_col).cast("string"), 2, "0"))


def week_of(ts) -> Column:
    """Monday of the week as a DATE; date arithmetic only, so the session time zone plays no part."""
    day = F.to_date(_c(ts))
    return F.date_sub(day, F.weekday(day))


def month_of(ts) -> Column:
    return F.trunc(F.to_date(_c(ts)), "month")


def any_of(flag) -> Column:
    return F.max(flag.cast("int"))
