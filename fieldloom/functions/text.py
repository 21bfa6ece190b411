"""Text functions as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that are booleans, dashes that are one dash.
TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")
DASHES = "‐‑‒–—―－﹣−"

#: Full-width forms, U+FF01 to U+FF5E, stand for ASCII 33 to 126 (drawing texts fold these alone).
_WIDE = "".join(chr(0xFEE0 + c) for c in range(33, 127))
_NARROW = "".join(chr(c) for c in range(33, 127))


@F.pandas_udf(StringType())
def _compatible(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(StringType())
def _folded(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v).casefold(), na_action="ignore")


_BEYOND_ASCII = r"[^\x00-\x7F]"


def nfkc(value: Column) -> Column:
    """Compatibility normal form. Only values with other characters than ASCII leave the JVM; the others are nulls there."""
    return F.coalesce(_compatible(F.when(value.rlike(_BEYOND_ASCII), value)), value)


def file_key(value: Column) -> Column:
    """Key under which file names collide: composed and case-folded."""
    return F.coalesce(_folded(F.when(value.rlike(_BEYOND_ASCII), value)), F.lower(value))


def normalize_id(value: Column) -> Column:
    """Identifier key: compatible forms, dashes to '-', no white space, upper case, no leading zeros in digit runs.

    Empty results are null. Floating-point columns go through number_key().
    """
    text = F.translate(value.cast("string"), DASHES, "-" * len(DASHES))
    text = F.translate(nfkc(text), DASHES, "-" * len(DASHES))
    text = F.upper(F.regexp_replace(text, r"(?U)\s+", ""))
    text = F.regexp_replace(text, r"(?<![0-9])0+(?=[0-9])", "")
    return F.nullif(text, F.lit(""))


def number_key(value: Column) -> Column:
    """normalize_id of a floating-point column: 103.0 reads 103."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return normalize_id(F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string")))


def bool_word(value: Column) -> Column:
    """true/t/yes/y/1 and false/f/no/n/0 in any case, else null."""
    word = F.lower(F.trim(value.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def sanitize(value: Column) -> Column:
    """Name part of a file: other characters than letters, digits, _ and - become _, none at the ends."""
    return F.trim(F.regexp_replace(value.cast("string"), r"(?U)[^\w\-]", "_"), F.lit("_"))


_DMS = r"^([+-]?\d+(?:\.\d+)?)\s*[°:]\s*(\d+(?:\.\d+)?)\s*['′:]\s*(\d+(?:\.\d+)?)\s*[\"″]?\s*([NSEW]?)$"


def coordinate(value: Column) -> Column:
    """Decimal degrees, or degrees, minutes and seconds with a hemisphere; null if it is neither or contradicts itself."""
    text = F.upper(F.trim(value.cast("string")))
    plain = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(E[+-]?\d+)?$"), text.cast("double"))
    part = lambda k: F.regexp_extract(text, _DMS, k)
    degrees, minutes, seconds = (F.nullif(part(k), F.lit("")).cast("double") for k in (1, 2, 3))
    side, minus = part(4), text.startswith("-")
    wrong = (minutes >= 60) | (seconds >= 60) | (minus & side.isin("N", "E"))
    sign = F.when(minus | side.isin("S", "W"), -1.0).otherwise(1.0)
    dms = F.when(degrees.isNotNull() & ~wrong, sign * (F.abs(degrees) + minutes / 60 + seconds / 3600))
    return F.coalesce(plain, dms)


def looks_garbled(value: Column) -> Column:
    """A Latin-1 sign or control beside another high character: bytes read in the wrong encoding."""
    return value.rlike("[\u0080-ÿ]*(?:[\u0080-¿×÷][\u0080-ÿ]|[\u0080-ÿ][\u0080-¿×÷])")


# Fixed value: what stands between the codes of a combined land-use code.
CODE_BREAKS = "[+/、,，]"


def landuse_major(value: Column) -> Column:
    """The first code of a combined land-use code."""
    return F.trim(F.element_at(F.split(value, CODE_BREAKS), 1))


def drawing_text(value: Column) -> Column:
    """Text of a drawing: full-width letters and signs as ASCII, white space as single blanks, none at the ends."""
    folded = F.translate(value, _WIDE + "　", _NARROW + " ")
    return F.trim(F.regexp_replace(folded, r"(?U)[\s\x1c-\x1f]+", " "))


def label_field(value: Column, pattern: str, field: str | None = None) -> dict[str, Column]:
    """Columns by field of a text that a pattern matches as a whole, null where it doesn't: the text itself under `field`,
    else the pattern's named groups."""
    whole = f"^(?:{re.sub(r'[(][?]P<', '(?<', pattern)})$"
    if field:
        return {field: F.when(value.rlike(whole), value)}
    return {name: F.when(value.rlike(whole), F.nullif(F.regexp_extract(value, whole, at), F.lit(""))) for name, at in re.compile(pattern).groupindex.items()}


def pointer(document: Column, path: str) -> Column:
    """The value at a JSON pointer such as /props/0/name, as text; ~1 stands for a slash, ~0 for a tilde. Null if there is none."""
    if path and not path.startswith("/"):
        raise ValueError("a pointer begins with a slash")
    steps = [x.replace("~1", "/").replace("~0", "~") for x in path.split("/")[1:]]
    quoted = lambda s: s.replace("'", "\\'")
    return F.get_json_object(document, "$" + "".join(f"[{s}]" if s.isdigit() else f"['{quoted(s)}']" for s in steps))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance on a sphere of 6371.0088 km."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0088) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def mercator_tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the web-map tile at a zoom level."""
    n = float(1 << zoom)
    phi = F.radians(lat)
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.ln(F.tan(phi) + 1 / F.cos(phi)) / F.lit(3.141592653589793)) / 2 * n)
    clip = lambda v: F.greatest(F.lit(0), F.least(F.lit(int(n) - 1), v)).cast("bigint")
    return clip(x), clip(y)
