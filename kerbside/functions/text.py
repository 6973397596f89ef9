"""String functions of the domain, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_name(name: Column) -> Column:
    """Upper case, Turkish letters to ASCII, no trailing ``MAHALLESI``, single spaces; missing becomes ``NAN``."""
    x = F.translate(F.upper(F.trim(F.coalesce(name, F.lit("nan")))), "İŞĞÜÖÇ", "ISGUOC")
    x = F.regexp_replace(x, r"\s+MAHALLESI$", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def slugify(text: Column) -> Column:
    """Lower-case ASCII words joined by hyphens."""
    x = F.lower(F.translate(text, "ıİşŞğĞüÜöÖçÇ", "iIsSgGuUoOcC"))
    return F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def hstore_value(tags: Column, key: str) -> Column:
    """The value of the first ``"key"=>"value"`` with this key; NULL if there is none."""
    got = F.regexp_extract(tags, f'"{key}"=>"([^"]*)"', 1)
    return F.when(tags.contains(f'"{key}"=>"'), got)


def escape_html(text: Column) -> Column:
    """The five reserved characters escaped; missing becomes empty."""
    x = F.coalesce(text, F.lit(""))
    #: Character and entity, the ampersand first.
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(plain), F.lit(entity))
    return x


def amenity_class(amenity: Column, healthcare: Column) -> Column:
    """One of hospital, clinic, doctors, pharmacy, by either tag; NULL for others."""
    classes = ["hospital", "clinic", "doctors", "pharmacy"]
    by_health = F.when(healthcare == "doctor", "doctors").when(healthcare.isin(*classes), healthcare)
    return F.when(amenity.isin(*classes), amenity).otherwise(by_health)


def starting_age(band: Column) -> Column:
    """The leading integer of an age band; NULL without one."""
    return F.nullif(F.regexp_extract(band, r"^\s*(\d+)", 1), F.lit("")).cast("int")


def is_centre(key: Column) -> Column:
    """District keys that name a province's centre."""
    return key.endswith(" MERKEZ")


def long_label(name: Column, district: Column) -> Column:
    """``name (district)``."""
    return F.concat(name, F.lit(" ("), district, F.lit(")"))


def split_label(label: Column) -> tuple[Column, Column]:
    """Name and district of a long label."""
    pattern = r"^(.*) \((.*)\)$"
    return F.regexp_extract(label, pattern, 1), F.regexp_extract(label, pattern, 2)


#: What stands for a missing label, number, and distance.
UNKNOWN, NO_DATA, NO_MAP_DATA = "Bilinmiyor", "Veri yok", "OSM verisi yok"


def or_unknown(label: Column) -> Column:
    """A label, or what stands for a missing one."""
    return F.coalesce(label, F.lit(UNKNOWN))


def whole(x: Column) -> Column:
    """A number rounded half-even to a whole one, as text."""
    return F.bround(x, 0).cast("bigint").cast("string")


def percent_text(x: Column) -> Column:
    """``%42``; a missing number says so."""
    return F.when(x.isNull(), F.lit(NO_DATA)).otherwise(F.concat(F.lit("%"), whole(x)))


def degrees_text(x: Column, digits: int = 1) -> Column:
    """``41.3°C``; a missing number says so."""
    return F.when(x.isNull(), F.lit(NO_DATA)).otherwise(F.concat(F.format_string(f"%.{digits}f", F.bround(x, digits)), F.lit("°C")))


def metres_text(x: Column) -> Column:
    """``1,234 m``; a missing distance says so."""
    return F.when(x.isNull(), F.lit(NO_MAP_DATA)).otherwise(F.concat(F.format_number(F.bround(x, 0), 0), F.lit(" m")))


def explanation(*pieces: tuple[str, Column]) -> Column:
    """``title: text`` pieces joined by line breaks of a page; texts are escaped, a missing one is empty."""
    return F.concat_ws("<br>", *[F.concat(F.lit(f"{title}: "), escape_html(x)) for title, x in pieces])


def region_of(url: Column, country: str = "turkey") -> Column:
    """The region's name in a map extract's address of a country; empty without one."""
    return F.regexp_extract(url, f"{country}/(.+?)-latest", 1)
