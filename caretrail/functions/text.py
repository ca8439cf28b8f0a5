"""Text functions: phone numbers, addresses, file names, links, units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caretrail.functions.defaults import col, null_if_empty

# The characters the web client trims and matches as white space. Java's \s and Spark's
# trim know fewer.
BLANKS = (
    "\t\n\u000b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
STATE_ZIP = f"([A-Z]{{2}})[{BLANKS}]+(.+)"
# a country after two or more other parts
WITH_COUNTRY = f"(?s)^([^,]*,.*),[{BLANKS}]*(?:USA|US)[{BLANKS}]*\\z"
THREE_PARTS = "^[^,]*,[^,]*,"


def trim_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def normalize_phone(c: Column | str) -> Column:
    """Digits only, ten digits get a leading 1; text without any digit stays as it is; '' becomes null."""
    raw = null_if_empty(c)
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return F.when(F.length(digits) == 10, F.concat(F.lit("1"), digits)).otherwise(
        F.coalesce(null_if_empty(digits), raw)
    )


def parse_address(c: Column | str) -> Column:
    """One-line address to struct(address, city, state, zipCode): the first two parts and the last one, when there are
    three or more besides the country; otherwise all of it is the address.
    """
    text = col(c)
    base = F.regexp_replace(text, WITH_COUNTRY, "$1")
    full = base.rlike(THREE_PARTS)
    last = trim_blanks(F.substring_index(base, ",", -1))
    state = F.regexp_extract(last, STATE_ZIP, 1)
    second = F.substring_index(F.substring_index(base, ",", 2), ",", -1)
    return F.when(
        text.isNotNull(),
        F.struct(
            F.when(full, trim_blanks(F.substring_index(base, ",", 1))).otherwise(text).alias("address"),
            F.when(full, trim_blanks(second)).otherwise("").alias("city"),
            F.when(full, F.coalesce(null_if_empty(state), last)).otherwise("").alias("state"),
            F.when(full, F.regexp_extract(last, STATE_ZIP, 2)).otherwise("").alias("zipCode"),
        ),
    )


def parse_int(c: Column | str) -> Column:
    """Leading integer of form text; no digits, '' or out of range give null."""
    return F.regexp_extract(col(c), f"^[{BLANKS}]*([+-]?[0-9]+)", 1).try_cast("int")


def file_ext(c: Column | str) -> Column:
    """Text after the last dot, the whole name when there is none."""
    return F.substring_index(col(c), ".", -1)


def base_name(c: Column | str) -> Column:
    """Last path segment; ``document.pdf`` when it is empty."""
    return F.when(
        col(c).isNotNull(), F.coalesce(null_if_empty(F.substring_index(col(c), "/", -1)), F.lit("document.pdf"))
    )


def url_path(c: Column | str) -> Column:
    """Path of a full URL; anything else is a path already."""
    text = col(c)
    path = F.try_parse_url(text, F.lit("PATH"))
    return F.when(text.contains("://"), F.when(path == "", "/").otherwise(path)).otherwise(text)


def website_url(c: Column | str) -> Column:
    """Link target of a stored website."""
    site = null_if_empty(c)
    return F.when(site.startswith("http"), site).otherwise(F.concat(F.lit("https://"), site))


def address_line(address: Column | str, city: Column | str) -> Column:
    """"address, city"; the address alone without a city; '' without an address."""
    street = null_if_empty(address)
    return F.when(street.isNotNull(), F.concat_ws(", ", street, null_if_empty(city))).otherwise("")


def locality_line(city: Column | str, state: Column | str, zip_code: Column | str) -> Column:
    """The non-empty ones of city, state and zip, joined."""
    return F.concat_ws(", ", null_if_empty(city), null_if_empty(state), null_if_empty(zip_code))


def clinic_address_lines(address: Column | str, city: Column | str, state: Column | str, zip_code: Column | str) -> Column:
    """Second address line of a clinic; null unless address, city and state are all there."""
    town, region = null_if_empty(city), null_if_empty(state)
    return F.when(
        null_if_empty(address).isNotNull(),
        F.concat(town, F.lit(", "), region, F.lit(" "), F.coalesce(col(zip_code), F.lit(""))),
    )


def _js_number(c: Column) -> Column:
    """A number as the web client prints it: no ``.0`` on whole numbers, ``undefined`` when absent."""
    return F.coalesce(F.regexp_replace(c.cast("string"), r"\.0$", ""), F.lit("undefined"))


def import_note(rating: Column | str, reviews: Column | str, types: Column | str) -> Column:
    """Note kept with an imported listing; null when the type list is missing."""
    return F.concat(
        F.lit("Google Rating: "), _js_number(col(rating)),
        F.lit(" ("), _js_number(col(reviews)), F.lit(" reviews)\nBusiness Types: "),
        F.array_join(col(types), ", "),
    )


def fmt_distance(c: Column | str) -> Column:
    """Metres as "12.5 km (8 miles)"."""
    metres = col(c).cast("double")
    return F.format_string("%.1f km (%d miles)", metres / 1000, F.floor(metres / 1609 + 0.5))


def fmt_coord(c: Column | str) -> Column:
    """A coordinate with four decimals."""
    return F.format_string("%.4f", col(c).cast("double"))
