"""Text cleaning, reason labels and the boundary vocabulary."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.common import once


def capped(text: Column, maximum: int | None) -> Column:
    """Cut at ``maximum`` characters, if given, and drop trailing white space, if longer; a display width, not for what is stored."""
    if maximum is None:
        return text
    cut = F.regexp_replace(F.substring(text, 1, maximum), r"(?U)\s+$", "")
    return F.when(F.length(text) > maximum, cut).otherwise(text)


def or_default(text: Column, default: str) -> Column:
    return F.when(text.isNull() | (text == ""), F.lit(default)).otherwise(text)


def safe_text(value: Column, maximum: int | None = None, default: str = "") -> Column:
    """Control characters out (tabs stay) and trimmed."""
    bare = F.regexp_replace(value, r"[\x00-\x08\x0A-\x1F]", "")
    return or_default(capped(F.regexp_replace(bare, r"(?U)^\s+|\s+$", ""), maximum), default)


def plain_text(value: Column, maximum: int | None = None, default: str = "") -> Column:
    """Control characters out, white space collapsed; markup stays text."""
    bare = F.regexp_replace(value, r"[\x00-\x08\x0B-\x1F]", "")
    flat = F.regexp_replace(F.regexp_replace(bare, r"(?U)\s+", " "), "^ | $", "")
    return or_default(capped(flat, maximum), default)


def signature(codes: Column) -> Column:
    return F.array_join(codes, ",")


def reason_label(code: Column) -> Column:
    return F.replace(code, F.lit("_"), F.lit(" "))


def slug(value: Column) -> Column:
    """Lower-case identifier, NULL when it is not one."""
    low = F.lower(F.trim(value))
    return F.when(low.rlike(r"^[a-z0-9_-]{1,64}$"), low)


def decimal_amount(value: Column) -> Column:
    """Exact amount from text with thousands separators; NULL when unusable."""
    return F.regexp_replace(F.trim(value), ",", "").try_cast("decimal(38,6)")


def canonical_amount(value: Column) -> Column:
    """One spelling per amount: significant digits and a power of ten, so 120 is 12E1; any zero is 0."""
    scaled = F.regexp_replace(value.cast("decimal(38,6)").cast("string"), r"\.", "")
    digits = F.regexp_replace(scaled, r"^(-?)0+(?=\d)", "$1")
    bare = F.regexp_replace(digits, "0+$", "")
    exponent = F.length(digits) - F.length(bare) - 6
    return F.when(bare.isin("", "-"), F.lit("0")).otherwise(F.concat(bare, F.lit("E"), exponent.cast("string")))


# --- fixed values: vocabulary that audited text must not use ----------------
BOUNDARY_PHRASES = (
    "strong buy", "strong sell", "target price", "price target", "position size", "position sizing",
    "expected return", "stop loss", "take profit", "entry point", "exit point", "risk reward",
)
BOUNDARY_WORDS = (
    "buy", "buys", "buying", "buyer", "buyers", "bought",
    "sell", "sells", "selling", "seller", "sellers", "sold",
    "hold", "holds",
    "overweight", "underweight",
    "allocate", "allocates", "allocating", "allocation",
    "guarantee", "guarantees", "guaranteed",
)


BOUNDARY_SEPARATORS = r"""[.\-_*/\\|+~:;,'"`()\[\]{}<>!?@#$%^&=]"""

# every listed word contains one of these
BOUNDARY_STEMS = ("buy", "bought", "sell", "sold", "hold", "weight", "allocat", "guarantee")


@F.pandas_udf(T.StringType())
def fold_unicode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC, format and control characters out, case folded (NULL stays NULL).

    Uses the standard library only, so workers need not have this package.
    """
    # planes 2 to 13 and the private planes hold neither format nor control characters
    points = itertools.chain(range(0x20000), range(0xE0000, 0xE1000))
    hidden = "".join(chr(c) for c in points if unicodedata.category(chr(c)) in ("Cf", "Cc"))
    pattern = re.compile("[" + re.escape(hidden) + "]")
    for text in batches:
        yield text.map(lambda v: pattern.sub("", unicodedata.normalize("NFKC", v)).casefold(), na_action="ignore")


def boundary_form(text: Column) -> Column:
    """Text as the vocabulary is matched against it.

    Only text with characters outside ASCII goes to Python; the rest is folded
    in the JVM. Punctuation runs between word characters and the gaps inside
    spelled-out words are removed.
    """
    plain = text.rlike(r"^[\x00-\x7F]*$")
    in_jvm = F.lower(F.regexp_replace(text, r"[\x00-\x1F\x7F]", ""))
    folded = F.coalesce(fold_unicode(F.when(~plain, text)), in_jvm)
    joined = F.regexp_replace(folded, rf"(?U)(?<=\w){BOUNDARY_SEPARATORS}+(?=\w)", "")
    spelled = F.regexp_replace(joined, r"(?U)(?<=\b\w)[ \t]+(?=\w\b)", "")
    return F.trim(F.regexp_replace(spelled, r"(?U)\s+", " "))


def boundary_term(text: Column) -> Column:
    """First listed phrase found, else the first word found, else NULL."""
    words = r"(?U)\b(?:" + "|".join(BOUNDARY_WORDS) + r")\b"

    def judge(form):
        phrase = F.coalesce(*[F.when(F.contains(form, F.lit(p)), F.lit(p)) for p in BOUNDARY_PHRASES])
        # a plain search is much cheaper than the word pattern and rules most texts out
        possible = F.lit(False)
        for stem in BOUNDARY_STEMS:
            possible = possible | F.contains(form, F.lit(stem))
        word = F.when(possible, F.nullif(F.regexp_extract(form, words, 0), F.lit("")))
        return F.coalesce(phrase, word)

    return once(boundary_form(text), judge)
