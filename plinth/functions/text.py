"""Column functions whose results equal those of the usual Python and IRI string operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that Python strips, and trims inside texts, as a character class.
SPACE = r"[\t-\r \x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encode_for_uri(text: Column) -> Column:
    """Percent-encodes everything but letters, digits and ``-._~`` of ASCII, in UTF-8."""
    form = F.url_encode(text)
    return F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


#: The same characters one by one.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def stripped(text: Column) -> Column:
    """Without white space at both ends, in time that grows with the text whatever stands inside it."""
    return F.btrim(text, F.lit(SPACES))


def collapsed(text: Column) -> Column:
    """Runs of white space become one space. Single spaces, the most of it, are passed over and not replaced by themselves."""
    other = SPACE.replace("\\r ", "\\r")
    return F.regexp_replace(text, f"(?:{other}| (?={SPACE})){SPACE}*", " ")


def cache_key(*parts: Column) -> Column:
    """md5 of the parts, each stripped, in lower case and with collapsed white space, joined by ``||``."""
    return F.md5(F.concat_ws("||", *(collapsed(F.lower(stripped(F.coalesce(p.cast("string"), F.lit("None"))))) for p in parts)))


def first_filled(candidates: list[Column], default: str = "") -> Column:
    """The first candidate that is not null and not blank, stripped."""
    return F.coalesce(*(F.nullif(stripped(c.cast("string")), F.lit("")) for c in candidates), F.lit(default))
