"""Column expressions for reading and rounding the values of a text table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sumtrail.functions import fixed_values as fixed

# Beyond this magnitude a double carries no digit behind the rounding position.
_EXACT_DOUBLE = float(2**52)


def half_up(x: Column, digits: int = 0) -> Column:
    """Round with halves going up (-2.5 gives -2), safe for any magnitude."""
    scale = 10**digits
    scaled = x * F.lit(float(scale))
    rounded = F.floor(scaled + F.lit(0.5)) / F.lit(float(scale))
    return F.when(F.abs(scaled) < F.lit(_EXACT_DOUBLE), rounded).otherwise(x)


def half_up_long(x: Column) -> Column:
    """Half-up rounding of a small value (a score, a percentage) to bigint."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x))


def ratio(top: Column, bottom: Column, empty: float = 0.0) -> Column:
    """``top / bottom``; a zero or missing ``bottom`` gives ``empty``."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(float(empty)))


def strip(c: Column) -> Column:
    """Without blanks at both ends; a text between two visible ASCII characters is taken as it is."""
    ends = F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~")
    return F.when(ends, c).otherwise(F.trim(c, F.lit(fixed.BLANKS)))


def is_missing(c: Column) -> Column:
    """True for NULL, blank and the usual written markers for "no value"."""
    return c.isNull() | F.lower(strip(c)).isin(fixed.MISSING_MARKERS)


def _parsed(c: Column, pattern: str) -> Column:
    """Number matched by ``pattern`` after dropping currency signs and blanks.

    Written so that the text is scanned once: no match gives '', which casts
    to NULL, and ``nullif`` drops infinities without repeating its argument.
    """
    bare = F.translate(c, "£$€," + fixed.BLANKS, "")
    number = F.regexp_extract(bare, pattern, 1).try_cast("double")
    return F.nullif(F.nullif(number, F.lit(float("inf"))), F.lit(float("-inf")))


def to_number(c: Column) -> Column:
    """Number in a cell such as ``£1,200.50`` or ``12%``; NULL when there is none."""
    return _parsed(c, fixed.NUMBER_OR_PERCENT)


def to_amount(c: Column) -> Column:
    """Like :func:`to_number`, with 0 for anything unreadable; takes no % sign."""
    return F.coalesce(_parsed(c, fixed.NUMBER_TEXT), F.lit(0.0))


def leading_number(c: Column) -> Column:
    """Longest numeric prefix (``12 pcs`` gives 12); NULL when there is none."""
    prefix = F.regexp_extract(F.translate(c, "£$€,", ""), fixed.LEADING_NUMBER, 1)
    return F.when(prefix != "", prefix.try_cast("double"))


def price_of(c: Column) -> Column:
    return F.coalesce(leading_number(c), F.lit(0.0))


def quantity_of(c: Column) -> Column:
    """Unreadable and zero quantities count as one."""
    q = leading_number(c)
    return F.when(q.isNull() | (q == 0), F.lit(1.0)).otherwise(q)


def looks_like_date(c: Column, stripped: bool = False) -> Column:
    """True for the shapes that :func:`to_day` reads; ``stripped`` says that ``c`` has no blanks at its ends."""
    s = c if stripped else strip(c)
    shapes = [
        fixed.ISO_DAY, fixed.SLASH_DAY, fixed.DAY_MONTH_NAME,
        fixed.MONTH_NAME_DAY, fixed.YEAR_SLASH_DAY, fixed.SLASH_DAY_TIME,
    ]
    return F.coalesce(s.rlike("|".join(f"(?:{shape})" for shape in shapes)), F.lit(False))


def looks_like_boolean(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(fixed.BOOLEAN_WORD), F.lit(False))


def _day(year: Column, month: Column, day: Column) -> Column:
    """Date from text parts; two-digit years below 50 are in this century."""
    y = year.try_cast("int")
    full = F.when(F.length(year) > 2, y).when(y < 50, y + 2000).otherwise(y + 1900)
    # ``concat`` and not ``concat_ws``: an unknown part makes the day unknown.
    text = F.concat(F.lpad(full.cast("string"), 4, "0"), F.lit("-"), month, F.lit("-"), day)
    return text.try_cast("date")


def to_day(c: Column, dayfirst: bool = False, stripped: bool = False) -> Column:
    """Calendar day of a date cell; NULL when no supported shape fits.

    Each shape has its own parser and only the one that fits is evaluated.
    Slashed and dotted dates are month first unless ``dayfirst``; ``stripped``
    says that ``c`` has no blanks at its ends.
    """
    s = c if stripped else strip(c)
    parts = r"^(\d{1,4})[/.](\d{1,2})[/.](\d{1,4})"
    a, b, y = (F.regexp_extract(s, parts, i) for i in (1, 2, 3))
    month, day = (b, a) if dayfirst else (a, b)
    named = r"^(\d{1,2})\s+([A-Za-z]{3})[A-Za-z]*\s+(\d{2,4})$"
    named_first = r"^([A-Za-z]{3})[A-Za-z]*\s+(\d{1,2}),?\s+(\d{2,4})$"
    return (
        F.when(s.rlike(fixed.ISO_DAY), s.try_cast("timestamp").cast("date"))
        .when(s.rlike(fixed.YEAR_SLASH_DAY), _day(a, b, y))
        .when(s.rlike(f"{fixed.SLASH_DAY}|{fixed.SLASH_DAY_TIME}"), _day(y, month, day))
        .when(
            s.rlike(fixed.DAY_MONTH_NAME),
            _day(F.regexp_extract(s, named, 3), _month_text(F.regexp_extract(s, named, 2)),
                 F.regexp_extract(s, named, 1)),
        )
        .when(
            s.rlike(fixed.MONTH_NAME_DAY),
            _day(F.regexp_extract(s, named_first, 3),
                 _month_text(F.regexp_extract(s, named_first, 1)),
                 F.regexp_extract(s, named_first, 2)),
        )
    )


def _month_text(name: Column) -> Column:
    months = F.create_map(*[
        F.lit(v) for i, m in enumerate(fixed.MONTHS) for v in (m.lower(), str(i + 1))
    ])
    return F.try_element_at(months, F.lower(name))


def plain_text(x: Column) -> Column:
    """Shortest plain decimal text of a double: 1200.0 gives 1200."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    fraction = F.regexp_replace(x.try_cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
    small = x.cast("string")
    return (
        F.when(whole, x.cast("bigint").cast("string"))
        .when(small.contains("E") & (F.abs(x) >= 1), F.coalesce(fraction, small))
        .otherwise(small)
    )


def finite(x: Column) -> Column:
    """A number as double; NULL for what is missing, not a number or infinite."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def total(x: Column) -> Column:
    """Sum of the finite numbers, as double; added as decimals, so that it does not depend on their order."""
    return F.sum(finite(x).cast("decimal(38,4)")).cast("double")
