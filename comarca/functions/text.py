"""Text, number, id and time functions."""

from functools import reduce

from pyspark.sql import Column, functions as F

from comarca import fixed

# The white space characters that are trimmed.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(_col(c), F.lit(SPACES))


def blank(c) -> Column:
    """True for NULL and for text without a visible character."""
    return F.coalesce(strip(c) == "", F.lit(True))


def or_default(c, default) -> Column:
    """NULL becomes the default."""
    return F.coalesce(_col(c), F.lit(default))


def or_default_blank(c, default) -> Column:
    """NULL and the empty text become the default."""
    return F.when(F.coalesce(_col(c), F.lit("")) == "", F.lit(default)).otherwise(_col(c))


def to_number(c) -> Column:
    """Number in the text as a double, NULL where it is not a plain number."""
    text = strip(c)
    plain = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(plain, text.try_cast("double"))


def to_whole(c) -> Column:
    """Integer part of the number in the text, NULL where it is not a number."""
    text = strip(c)
    digits = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
    return F.coalesce(digits, to_number(text).try_cast("bigint"))


def clean_code(c) -> Column:
    """Activity code without dashes, slashes, dots and white space."""
    return F.regexp_replace(_col(c).cast("string"), r"(?U)[-/\s.]", "")


def pad(c, width) -> Column:
    """Zero-pad to ``width``; longer text is kept whole and NULL or blank becomes zeros."""
    text = F.coalesce(strip(_col(c).cast("string")), F.lit(""))
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def company_id(base, order, check) -> Column:
    """14-digit establishment id."""
    return F.concat(pad(base, 8), pad(order, 4), pad(check, 2))


def repair_text(c) -> Column:
    """Undo UTF-8 that was read as Latin-1; text that does not convert back is kept."""
    text = _col(c)
    narrow = text.rlike(r"^[\x00-\xFF]*$")
    raw = F.encode(F.when(narrow, text), "ISO-8859-1")
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), text)


def fold_accents(c) -> Column:
    """Lower-case letters without their accents."""
    return F.translate(
        F.lower(_col(c)), "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn"
    )


def city_name(c) -> Column:
    """Display name of a city: repaired, mapped, else title case; Unknown when blank."""
    key = F.upper(repair_text(strip(c)))
    names = F.create_map(*[F.lit(v) for pair in fixed.CITY_NAMES.items() for v in pair])
    named = F.coalesce(F.element_at(names, key), F.initcap(F.lower(key)))
    return F.when(blank(c), F.lit(fixed.UNKNOWN_CITY)).otherwise(named)


_DATE, _TIME, _ZONE = r"\d{4}-\d{2}-\d{2}", r"[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?", r"(Z|[+-]\d{2}:?\d{2})"


def instant(c) -> Column:
    """ISO-8601 date or date and time as a timestamp, NULL for anything else; UTC where no zone is named.

    The session's own zone plays no part.
    """
    read = _col(c)
    full = (
        F.when(read.rlike(f"^{_DATE}{_TIME}{_ZONE}$"), read)
        .when(read.rlike(f"^{_DATE}{_TIME}$"), F.concat(read, F.lit("Z")))
        .when(read.rlike(f"^{_DATE}$"), F.concat(read, F.lit("T00:00:00Z")))
    )
    return F.try_to_timestamp(full)


def iso(c) -> Column:
    """Timestamp as ISO-8601 text in UTC, with the fraction only when there is one."""
    utc = F.to_utc_timestamp(_col(c), F.current_timezone())
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(utc, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def holds_text(columns, needle) -> Column:
    """Literal, case-insensitive containment in any of ``columns``; a blank needle holds."""
    needle = needle.strip().lower()
    if not needle:
        return F.lit(True)
    found = [
        F.lower(F.coalesce(_col(c).cast("string"), F.lit(""))).contains(needle) for c in columns
    ]
    return reduce(lambda a, b: a | b, found)


def address(street, number, district, city) -> Column:
    """Postal address text for geocoding."""
    empty = F.lit(None).cast("string")
    kept = lambda c: F.when(~blank(c), strip(c)).otherwise(empty)
    house = F.when(~strip(number).isin(fixed.NO_NUMBER), kept(number)).otherwise(empty)
    front = F.when(~blank(street), F.concat_ws(", ", kept(street), house)).otherwise(empty)
    return F.concat_ws(
        ", ", front, kept(district), kept(city), *[F.lit(t) for t in fixed.ADDRESS_TAIL]
    )
