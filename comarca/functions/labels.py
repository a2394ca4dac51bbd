"""Categories, labels and display texts."""

from pyspark.sql import Column, functions as F

from comarca import fixed
from comarca.functions.text import or_default_blank, pad


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def _lookup(pairs, key):
    return F.element_at(F.create_map(*[F.lit(v) for pair in pairs for v in pair]), key)


def business_type(code, preset="broad") -> Column:
    """Type of business by activity code; earlier types win where code sets overlap."""
    c = _col(code)
    if preset == "tech":
        return F.when(c.isin(fixed.TECH_CODES), "tech").otherwise("repairs")
    return (
        F.when(c.isin(fixed.TECH_CODES_BROAD), "tech")
        .when(c.isin(fixed.REPAIRS_CODES_BROAD), "repairs")
        .when(c.isin(fixed.RETAIL_CODES), "retail")
        .otherwise("gastronomy")
    )


def _prefix(code):
    return F.coalesce(F.substring(_col(code).cast("string"), 1, 2), F.lit(""))


def category(code) -> Column:
    return F.coalesce(
        _lookup(fixed.CATEGORIES.items(), _prefix(code)), F.lit(fixed.CATEGORY_OTHER)
    )


def subcategory_label(code) -> Column:
    pairs = [(k, v[0]) for k, v in fixed.SUBCATEGORIES.items()]
    return F.coalesce(_lookup(pairs, _prefix(code)), F.lit(fixed.SUBCATEGORY_OTHER[0]))


def subcategory_icon(code) -> Column:
    pairs = [(k, v[1]) for k, v in fixed.SUBCATEGORIES.items()]
    return F.coalesce(_lookup(pairs, _prefix(code)), F.lit(fixed.SUBCATEGORY_OTHER[1]))


def size_label(size) -> Column:
    return F.coalesce(_lookup(fixed.SIZES.items(), pad(size, 2)), F.lit(fixed.SIZE_OTHER))


def tech_name(name, company) -> Column:
    """Trade name, or a name made from the id where there is none."""
    made = F.concat(F.lit(fixed.TECH_NAME), F.substring(_col(company), 1, 8))
    return F.when(F.coalesce(_col(name), F.lit("")) == "", made).otherwise(_col(name))


def display_name(name) -> Column:
    return or_default_blank(name, fixed.NO_NAME)


def density_label(total, sector="all", hub_text=None) -> Column:
    """Sentence about the number of shops of a sector."""
    n = _col(total)
    if sector == "all":
        text = F.format_string(fixed.DENSITY_ALL, n)
        text = text if hub_text is None else F.coalesce(_col(hub_text), text)
    else:
        title, noun = fixed.DENSITY_SECTOR.get(sector, fixed.DENSITY_SECTOR_OTHER)
        text = F.format_string(f"{title} en funcionamiento: %d {noun}.", n)
    return F.when(n == 0, F.lit(fixed.DENSITY_NONE)).otherwise(text)


def percent(part, whole, digits=1) -> Column:
    """Share in percent, rounded half up; zero for an empty whole."""
    share = F.round(_col(part) / F.nullif(_col(whole), F.lit(0)) * 100, digits)
    return F.coalesce(share, F.lit(0.0))


def sector_filter(code, sector) -> Column:
    """Keep rows of a map sector; ``all`` keeps every row, an unknown sector none."""
    if sector == "all":
        return F.lit(True)
    codes = fixed.SECTORS.get(sector)
    return F.trim(_col(code).cast("string")).isin(codes) if codes else F.lit(False)
