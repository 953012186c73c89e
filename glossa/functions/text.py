"""Tokenisers and string functions as column expressions; Arrow UDFs only where Spark has no built-in."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Runs of letters: Unicode letters and the numbers that aren't decimal digits.
LETTERS = r"[\p{L}\p{Nl}\p{No}]+"


def letters(text: Column) -> Column:
    """Lower-cased runs of letters; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LETTERS), F.lit(0))


def cased_letters(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LETTERS), F.lit(0))


def keyword_tokens(text: Column) -> Column:
    """Letters, after no-break spaces, line feeds and hyphens have become spaces."""
    return letters(F.regexp_replace(text, "[ \n-]", " "))


def sentences(text: Column) -> Column:
    """Cut after ., ! or ? that white space follows."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: s != "")


@F.pandas_udf(ArrayType(StringType()))
def unicode_words(text: pd.Series) -> pd.Series:
    """Default Unicode word segmentation, punctuation kept, single spaces dropped."""
    import regex

    cut = regex.compile(r"(?wV1)\b")
    return text.map(lambda t: [x for x in cut.split(t) if x not in ("", " ")] if t is not None else None)


def unicode_words_no_punct(text: Column) -> Column:
    """Lower-cased Unicode words with a letter or digit."""
    return F.filter(F.transform(unicode_words(text), F.lower), lambda t: F.regexp_like(t, F.lit(r"[\p{L}\p{N}]")))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t) if t is not None else None)


@F.pandas_udf(ArrayType(StringType()))
def nfc_all(items: pd.Series) -> pd.Series:
    return items.map(lambda xs: [unicodedata.normalize("NFC", x) for x in xs] if xs is not None else None)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t) if t is not None else None)


def compatible_tokens(text: Column) -> Column:
    """Compatibility-composed, lower-cased, cut at white space."""
    return F.filter(F.split(F.lower(nfkc(text)), r"\s+"), lambda t: t != "")


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def match_or_null(text: Column, pattern: str, group: int = 1) -> Column:
    """The group, or null where the pattern doesn't match."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, group))


def flat_lower(parts: Column) -> Column:
    return F.lower(F.array_join(parts, " "))


#: Characters whose one upper-case character isn't the whole of their full mapping (ß: SS), and these characters.
_SINGLE = [(c, "ẞ" if c == "ß" else c.title()) for c in map(chr, range(0x10000)) if len(c.upper()) > 1 and (c == "ß" or len(c.title()) == 1)]


def upper_first(text: Column) -> Column:
    """The first character, mapped to one character as in SQL (ß: ẞ), or kept where there is none."""
    first = F.substring(text, 1, 1)
    upper = F.when(F.length(F.upper(first)) <= 1, F.upper(first)).otherwise(F.translate(first, *map("".join, zip(*_SINGLE, strict=True))))
    return F.concat(upper, F.substring(text, 2, 2**31 - 1))


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.translate(F.substring(text, 1, 1), "İ", "i")), F.substring(text, 2, 2**31 - 1))


_ENTITY = re.compile(r"&(#[xX]?)?(\w+);")


def unescape_text(text: str) -> str:
    """Numeric and named character references; what isn't one stays."""
    from html.entities import name2codepoint

    def value(m: re.Match) -> str:
        kind, body = m.group(1), m.group(2)
        try:
            if kind in ("#x", "#X"):
                return chr(int(body, 16))
            if kind == "#":
                return chr(int(body))
            return chr(name2codepoint[body])
        except (KeyError, ValueError, OverflowError):
            return m.group(0)

    return _ENTITY.sub(value, text)


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unescape_text(t) if t is not None else None)


def numeric_entity(code: Column) -> Column:
    """The character of a decimal code; empty above the basic plane or where it is no code."""
    n = F.expr("0") + F.try_to_number(code, F.lit("9999999")).cast("int")
    return F.coalesce(F.when((n >= 0) & (n < 0x10000), F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")), F.lit(""))


def normal_title(title: Column, namespaces: dict[str, str] | None = None) -> Column:
    """Underscores and runs of white space become one space; the namespace is named in its normal form, and what follows
    it, or the whole title, starts with a capital."""
    clean = F.trim(F.regexp_replace(title, r"[\s_]+", " "))
    space = F.regexp_extract(clean, r"^([^:]*):\s*(.*)$", 1)
    rest = F.regexp_extract(clean, r"^([^:]*):\s*(.*)$", 2)
    known = F.lit(None).cast("string")
    for key, name in (namespaces or {}).items():
        known = F.when(F.lower(F.trim(space)) == key.lower(), F.lit(name)).otherwise(known)
    split = F.regexp_like(clean, F.lit(r"^[^:]+:"))
    return F.when(split & known.isNotNull(), F.concat(known, F.lit(":"), upper_first(rest))).when(split, F.concat(upper_first(F.trim(space)), F.lit(":"), upper_first(rest))).otherwise(upper_first(clean))


def page_url(base: str, page_id: Column) -> Column:
    return F.concat(F.lit(f"{base}?curid="), page_id.cast("string"))


def url_file_name(url: Column) -> Column:
    """The last segment of a url's path."""
    return F.element_at(F.split(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[^:/]+://", ""), "/"), -1)


def as_list(item: Column, is_list: bool) -> Column:
    return item if is_list else F.array(item)


def content_words(tokens: Column, stop: list[str] | None = None) -> Column:
    """Tokens longer than one character that aren't stop words (by default the Norwegian list)."""
    if stop is None:
        from pyspark.ml.feature import StopWordsRemover

        stop = StopWordsRemover.loadDefaultStopWords("norwegian")
    listed = F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>")
    return F.filter(tokens, lambda t: (F.length(t) > 1) & ~F.array_contains(listed, t))
