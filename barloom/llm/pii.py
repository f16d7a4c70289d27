"""Personal data: patterns propose spans, checks confirm them, words nearby adjust the score.

A span's score is its pattern's start value, plus what its validator adds or
takes, plus what context words within ``reach`` characters add. Spans at or
above ``threshold`` are kept. The base kinds (email, ip, card, phone) start at
the threshold, so a base match that passes its own check always stays.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

THRESHOLD, REACH = 0.6, 60

SPANS = ArrayType(StructType([
    StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()),
    StructField("score", DoubleType()),
]))

#: fixed values of the base kinds, in the order of the digest
BASE = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a match cannot begin inside a run of digits whose begin has failed, so only begins of runs are tried
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGIT = re.compile("[0-9]")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SOCIAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

CONTEXT = {
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta", "swift", "bic"),
    "short_card": ("card", "credit", "visa", "amex", "mastercard", "karte", "carte", "tarjeta", "cvv", "expires"),
    "social": ("ssn", "social security", "sozialversicherung", "tax id", "taxpayer"),
}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        d = ord(x) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an account number's check digits hold."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(x, 36)) for x in turned)) % 97 == 1


def only_digits(text: str) -> str:
    return "".join(x for x in text if "0" <= x <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them, read outwards from each @ so that long runs cost linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        done = at + 1
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", done)


def _matches(pattern: re.Pattern, passes: Callable[[str], bool]) -> Callable[[str], Iterator[tuple[int, int]]]:
    def spans(text: str) -> Iterator[tuple[int, int]]:
        return ((m.start(), m.end()) for m in pattern.finditer(text) if passes(m[0]))

    return spans


def _parts_fit(found: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in found.split("."))


def _card(found: str) -> bool:
    digits = only_digits(found)
    return 16 <= len(digits) <= 19 and luhn(digits)


def _short_card(found: str) -> bool:
    digits = only_digits(found)
    return 13 <= len(digits) <= 15 and digits[0] in "3456" and luhn(digits)


def _iban(found: str) -> bool:
    plain = found.replace(" ", "")
    return 15 <= len(plain) <= 34 and mod97(plain)


def _social(found: str) -> bool:
    area, group, serial = found.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


#: kind: (how to find confirmed spans, score of a confirmed span, what a context word adds)
KINDS: dict[str, tuple[Callable[[str], Iterator[tuple[int, int]]], float, float]] = {
    "email": (_emails, 0.9, 0.0),
    "ip": (_matches(ADDRESS, _parts_fit), 0.6, 0.0),
    "card": (_matches(DIGITS, _card), 0.8, 0.0),
    "phone": (_matches(PHONE, lambda x: 8 <= len(only_digits(x)) <= 15), 0.6, 0.0),
    "iban": (_matches(IBAN, _iban), 0.7, 0.2),
    "short_card": (_matches(DIGITS, _short_card), 0.3, 0.4),
    "social": (_matches(SOCIAL, _social), 0.3, 0.4),
}


def found_in(text: str | None, threshold: float = THRESHOLD, reach: int = REACH) -> list[Span]:
    """Spans of a whole text by kind and start; none in a null text."""
    out, numbers = [], text is not None and DIGIT.search(text) is not None
    for kind, (find, score, more) in KINDS.items():
        if kind != "email" and not numbers:
            continue  # every other kind holds a digit
        for start, end in find(text or ""):
            own = score
            if more:
                near = text[max(0, start - reach) : end + reach].lower()
                own += more * any(re.search(rf"(?<![a-z]){re.escape(x)}(?![a-z])", near) for x in CONTEXT[kind])
            if own >= threshold or kind in BASE:
                out.append(Span(kind, start, end, round(own, 2)))
    return out


def _nested(groups: list[list[tuple]], kind: ArrayType) -> pa.Array:
    from pyspark.sql.pandas.types import to_arrow_type

    names = kind.elementType.names
    return pa.array([[dict(zip(names, x, strict=True)) for x in own] for own in groups], to_arrow_type(kind))


def spans_of(text_col, threshold: float = THRESHOLD, reach: int = REACH):
    """Column of all spans (kind, start, end, score) of a text column."""
    @arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        return _nested([found_in(x.as_py(), threshold, reach) for x in texts], SPANS)

    return spans(text_col)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans) per row; null and empty texts have no spans, repeated rows are read each, other columns are left out."""
    return docs.select(F.col(id_col).alias("doc_id"), spans_of(F.col(text_col), threshold).alias("spans"))


def masked_text(text: str | None, threshold: float = THRESHOLD) -> str | None:
    """The text with every found span replaced by its kind; of overlapping spans the one that begins first, then the longest, gives the name."""
    if text is None:
        return None
    out, done, name = [], 0, None
    upto = 0
    for span in sorted(found_in(text, threshold), key=lambda x: (x.start, -x.end)):
        if name is not None and span.start < upto:
            upto = max(upto, span.end)
            continue
        if name is not None:
            out.append(f"[{name}]")
            done = upto
        out.append(text[done : span.start])
        name, upto = span.kind.upper(), span.end
    if name is not None:
        out.append(f"[{name}]")
        done = upto
    out.append(text[done:])
    return "".join(out)


def masked(text_col, threshold: float = THRESHOLD):
    """Column of texts with their personal data masked; null stays null."""
    @arrow_udf(StringType())
    def mask(texts: pa.Array) -> pa.Array:
        return pa.array([masked_text(x.as_py(), threshold) for x in texts], pa.string())

    return mask(text_col)


def digest(spans: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans as one string, from (doc_id, spans)."""
    def of(kind: str):
        return F.filter("spans", lambda x: x["kind"] == kind)

    def joined(kinds):
        """The finder lists spans by kind as listed, then start."""
        own = F.filter("spans", lambda x: x["kind"].isin(list(kinds)))
        return F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    return spans.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(BASE), 256).alias("base_sha256"), joined(KINDS).alias("spans"),
    )
