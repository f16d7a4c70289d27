"""Secrets by patterns and by a battery of randomness tests.

Candidates are runs of at least ``SHORTEST`` characters of the usual encodings,
an equals sign being padding at their end only, and the parts of such a run
between slashes, between hyphens and underscores, and between any of these; so a
finding can lie within another. For its inferred encoding a candidate is tested for being drawn uniformly: the
chi-squared statistic of its symbols, Wald-Wolfowitz runs about the middle of
the alphabet, and the correlation of neighbours, the smallest p-value times
three. Candidates that pass are held against ordinary writing: under the
corpus' own symbol frequencies the same statistic has a known mean and
variance for every length, which gives a p-value that a short candidate cannot
make small. The Benjamini-Hochberg rule within classes of length keeps the
share of false findings at ``RATE``. p-values are rounded up to powers of
2^(-1/8), so the ranks come from counts per step instead of a sort.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from barloom.llm.pii import _nested
from barloom.llm.shared import written
from barloom.llm.words import chunks

#: fixed values of the base kinds, in the order of ties
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18}

SHORTEST, LEVEL, RATE = 20, 0.01, 0.05
#: least lengths of the classes within which false findings are controlled
CLASSES = (20, 32, 48, 96)
STEPS, LAST = 8, 4000
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}=*")
#: parts of a run that are candidates of their own
PARTS = tuple(re.compile(f"[^{signs}]{{20,}}") for signs in ("/", "_-", "/_-"))

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: alphabets in the order they are tried; a run of letters of one case is writing and has none
ENCODINGS = {
    "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "base32": _UPPER + "234567", "base36": _DIGITS + _LOWER, "BASE36": _DIGITS + _UPPER,
    "base62": _UPPER + _LOWER + _DIGITS, "base64": _UPPER + _LOWER + _DIGITS + "+/", "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_PLACES = {name: {c: k for k, c in enumerate(alphabet)} for name, alphabet in ENCODINGS.items()}
_SETS = {name: frozenset(alphabet) for name, alphabet in ENCODINGS.items()}

SPANS = ArrayType(StructType([
    StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()),
    StructField("class", IntegerType()), StructField("step", IntegerType()),
]))


def encoding(run: str) -> str | None:
    """The first alphabet that holds a run, padding aside; None for mere letters or digits and for other mixtures."""
    own = set(run.rstrip("="))
    if not own & _SETS["base62"] or own <= set(_DIGITS) or own <= set(_LOWER + "-_") or own <= set(_UPPER + "-_") or own <= set(_LOWER + _UPPER):
        return None
    return next((name for name, letters in _SETS.items() if own <= letters), None)


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(places: np.ndarray, k: int) -> tuple[float, float]:
    """The battery's p-value for uniform draws from k symbols, and the chi-squared statistic."""
    n = len(places)
    squares = float((np.bincount(places, minlength=k).astype(float) ** 2).sum())
    chi = k / n * squares - n
    free = k - 1
    p_chi = _upper(((max(chi, 1e-12) / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)))
    above = places >= k // 2
    a, b = int(above.sum()), int(n - above.sum())
    p_runs = 0.0
    if a and b:
        runs = 1 + int((above[1:] != above[:-1]).sum())
        mean = 1 + 2 * a * b / n
        variance = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * _upper(abs(runs - mean) / math.sqrt(variance)) if variance > 0 else 1.0
    x = places - places.mean()
    total = float((x * x).sum())
    p_serial = 2 * _upper(abs(float((x[1:] * x[:-1]).sum()) / total + 1 / n) * math.sqrt(n)) if total else 0.0
    return min(1.0, 3 * min(p_chi, p_runs, p_serial)), chi


def as_writing(chi: float, n: int, shares: np.ndarray) -> float:
    """Chance that ordinary writing of this length has so even symbols."""
    k = len(shares)
    two, three = float((shares**2).sum()), float((shares**3).sum())
    mean = k * (1 + (n - 1) * two) - n
    pairs = n * (n - 1) / 2 * (two - two**2) + n * (n - 1) * (n - 2) * (three - two**2)
    return _upper((mean - chi) / (k / n * 2 * math.sqrt(pairs))) if pairs > 0 else 1.0


def symbol_counts(docs: DataFrame, text_col: str = "text") -> dict[int, int]:
    """How often each byte occurs in all texts."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for _, data, _ in chunks(batch.column(0)):
                total += np.bincount(data, minlength=256)
        yield pa.record_batch([pa.array(np.arange(256, dtype=np.int32)), pa.array(total)], ["byte", "n"])

    rows = docs.select(F.col(text_col)).mapInArrow(counted, "byte int, n bigint").groupBy("byte").agg(F.sum("n").alias("n"))
    return {r["byte"]: r["n"] for r in rows.collect()}  # 256 rows


def shares_of(counts: dict[int, int]) -> dict[str, np.ndarray]:
    """Symbol frequencies of writing within each alphabet; one more of each symbol keeps them above zero."""
    out = {}
    for name, alphabet in ENCODINGS.items():
        n = np.array([counts.get(ord(c), 0) + 1 for c in alphabet], float)
        out[name] = n / n.sum()
    return out


def candidates(text: str, shares: dict[str, np.ndarray]) -> Iterator[tuple[str, int, int, int, int]]:
    """(kind, start, end, class of length, step of its p-value) of the runs that pass the battery."""
    for m in RUN.finditer(text):
        run = m[0].rstrip("=")
        for start, end in sorted({(0, len(run)), *(x.span() for cut in PARTS for x in cut.finditer(run))}):
            name = encoding(run[start:end])
            if name is None:
                continue
            alphabet = _PLACES[name]
            places = np.array([alphabet[c] for c in run[start:end]])
            p_uniform, chi = battery(places, len(alphabet))
            if p_uniform < LEVEL:
                continue
            p = as_writing(chi, len(places), shares[name])
            step = min(LAST, int(-STEPS * math.log2(p))) if p > 0 else LAST
            stop = m.end() if end == len(run) else m.start() + end  # padding belongs to the last part
            yield "random", m.start() + start, stop, sum(len(places) >= x for x in CLASSES) - 1, step


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= LEAST["assign"]:
            yield "assign", m.start(), m.end()
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= LEAST["access"]:
            yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


_SIGN = np.zeros(256, bool)
_SIGN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True


def _suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with an assignment sign or a run of 16 or more signs; others hold nothing of any kind."""
    ends = np.flatnonzero(~_SIGN[data])
    length = np.diff(np.concatenate([[-1], ends, [len(data)]])) - 1
    begin = np.concatenate([[0], ends + 1])[length >= 16]
    stop = begin + length[length >= 16]
    out = np.zeros(len(offsets) - 1, bool)
    for a, b in zip(np.searchsorted(offsets, begin, "right") - 1, np.searchsorted(offsets, stop, "left"), strict=True):
        out[a:b] = True  # a run may lie across rows; each is looked at
    equal = np.flatnonzero((data == 0x3D) | (data == 0x3A))
    out[np.searchsorted(offsets, equal, "right") - 1] = True
    return out


def spans_of(text_col, shares: dict[str, np.ndarray]):
    """Column of base spans and candidates, by start and then kind."""
    order = {kind: k for k, kind in enumerate((*BASE, "random"))}

    @arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        out: list[list[tuple]] = []
        for first, data, offsets in chunks(texts):
            suspect = _suspects(data, offsets)
            for i in range(len(offsets) - 1):
                if not suspect[i]:
                    out.append([])
                    continue
                text = texts[first + i].as_py() or ""
                found = [(*x, None, None) for x in base_spans(text)] + list(candidates(text, shares))
                out.append(sorted(found, key=lambda x: (x[1], order[x[0]])))
        return _nested(out, SPANS)

    return spans(text_col)


def thresholds(found: DataFrame, rate: float = RATE) -> DataFrame:
    """(class, least step) of the accepted candidates; a class without any has no row."""
    each = found.select(F.explode("spans").alias("s")).where("s.step is not null").select("s.class", "s.step")
    counts = each.groupBy("class", "step").agg(F.count("*").alias("n"))
    # at most classes times steps rows
    counts = counts.withColumn("below", F.sum("n").over(Window.partitionBy("class").orderBy(F.desc("step"))))
    counts = counts.withColumn("all", F.sum("n").over(Window.partitionBy("class")))
    fits = F.pow(F.lit(2.0), -F.col("step") / STEPS) * F.col("all") <= rate * F.col("below")
    return counts.where(fits).groupBy("class").agg(F.min("step").alias("least"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """(doc_id, spans) of every row, spans being (kind, start, end) by start.

    Null and empty texts have none. Repeated rows are read each and count each
    in the control of false findings. Other columns are not looked at.
    """
    shares = shares_of(symbol_counts(docs, text_col))
    found = written(docs.select(F.col(id_col).alias("doc_id"), spans_of(F.col(text_col), shares).alias("spans")), "suspects")
    limits = thresholds(found, rate).agg(F.map_from_entries(F.collect_list(F.struct("class", "least"))).alias("limits"))  # one row
    kept = F.filter("spans", lambda x: x["step"].isNull() | F.coalesce(x["step"] >= F.element_at("limits", x["class"]), F.lit(False)))
    named = F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return found.join(F.broadcast(limits)).select("doc_id", named.alias("spans"))


def digest(spans: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans as one string, from (doc_id, spans)."""
    def of(kind: str):
        return F.filter("spans", lambda x: x["kind"] == kind)

    def joined(own):
        return F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    base = F.filter("spans", lambda x: x["kind"].isin(list(BASE)))
    return spans.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
