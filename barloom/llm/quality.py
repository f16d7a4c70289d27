"""Quality rules whose cut-offs carry a guarantee against rejecting good documents.

Five rules compare a property of a text with a cut-off. Labelled documents are
the holdout. Per stratum (language) and rule the cut-offs are tried from the
loosest to the strictest; a cut-off is certified while the exact binomial bound
on its share of rejected good documents stays at or under the rule's share of
``risk``, at a level divided by the number of rules and strata (Bonferroni
across them, fixed-sequence testing along the cut-offs). So with probability
``1 - error`` no labelled stratum loses more than ``risk`` of its good documents. Of the
certified cut-offs the one that serves best on the labels is taken, the loosest
on a tie; where none can be certified the rule rejects nothing. Strata with
fewer than ``least`` good labels choose together, in one pooled stratum, and each
takes the pooled cut-off only as far as its own good labels certify it too. A
stratum without any labels takes the pooled cut-offs as they are and has no bound.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StructField, StructType

from barloom.llm.shared import written
from barloom.llm.words import CONTINUATION, Spans, chunks, mixed, repeated

#: fixed values of the base rules
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50

#: cut-offs of each rule, from the loosest on; a text is rejected above its cut-off
GRIDS = {
    "symbols": [x / 20 for x in range(60, 0, -1)],
    "capitals": [x / 40 for x in range(36, 0, -1)],
    "marks": [x / 40 for x in range(36, 0, -1)],
    "dup_lines": [x / 40 for x in range(39, 0, -1)],
    "repeats": [x / 40 for x in range(39, 0, -1)],
}
RISK, ERROR, LEAST = 0.05, 0.1, 500
#: good labelled documents that a rejected bad one may cost when a certified cut-off is chosen
COST = 10
POOLED = "\x00pooled"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")
MEASURES = StructType([StructField(x, LongType()) for x in COUNTS])

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[[x for x in range(33, 127) if not chr(x).isalnum()]] = True


def _lines(spans: Spans) -> tuple[np.ndarray, np.ndarray]:
    """Per row: lines with a word, and those equal to an earlier line."""
    data, offsets = spans.data, spans.offsets
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < offsets[1:]], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    ends = np.where(data[ends - 1] == 0x0A, ends - 1, ends) if len(starts) else ends[:0]
    wordy = np.searchsorted(spans.starts, ends) > np.searchsorted(spans.starts, starts)
    starts, ends = starts[wordy], ends[wordy]
    rows = np.searchsorted(offsets, starts, "right") - 1
    keys = mixed(spans.hashes(starts, ends) + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    total = np.bincount(rows, minlength=spans.rows)
    distinct = np.bincount(rows[np.unique(keys, return_index=True)[1]], minlength=spans.rows)
    return total, total - distinct


def _repeats(spans: Spans, n: int = 3) -> np.ndarray:
    """Words per row that stand in a window found twice or more in the row."""
    at, keys = spans.windows(n)
    at = at[repeated(spans.row_of_word[at], keys) > 1] if len(at) else at
    covered = np.zeros(len(spans.starts), bool)
    for k in range(n):
        covered[at + k] = True
    return np.bincount(spans.row_of_word[covered], minlength=spans.rows)


@arrow_udf(MEASURES)
def measured(texts: pa.Array) -> pa.Array:
    """The counts of every whole text; a null text has none of anything."""
    columns: list[list[np.ndarray]] = [[] for _ in COUNTS]
    for _, data, offsets in chunks(texts):
        spans = Spans(data, offsets)
        lines, again = _lines(spans)
        found = (
            spans.counts, spans.per_row(spans.inside & ~CONTINUATION[data]), spans.per_row(_SYMBOL[data]), again,
            _repeats(spans), lines, spans.per_row(_CAPITAL[data]), spans.per_row(_MARK[data]),
        )
        for column, values in zip(columns, found, strict=True):
            column.append(values)
    arrays = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in columns]
    return pa.StructArray.from_arrays(arrays, list(COUNTS))


def base_failed(words="n_words", repeats="n_repeat_words"):
    return (F.col(words) < LEAST_WORDS) | (100 * F.col(repeats) > MOST_REPEATED * F.col(words))


def properties() -> dict:
    """What the rules compare, from the counts."""
    def share(x, of):
        return F.when(F.col(of) > 0, F.col(x) / F.col(of)).otherwise(F.lit(0.0))

    return {
        "symbols": share("n_symbols", "n_words"), "capitals": share("n_capitals", "word_chars"),
        "marks": share("n_marks", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
    }


def _tail(n: int, k: int, p: float) -> float:
    """P(X <= k) of a binomial, exactly: the Clopper-Pearson bound is under p where this is at most the level."""
    if k >= n:
        return 1.0
    head, ratio = n * math.log1p(-p), math.log(p) - math.log1p(-p)
    i = np.arange(k + 1, dtype=float)
    steps = np.concatenate([[0.0], np.cumsum(np.log(n - i[1:] + 1) - np.log(i[1:]) + ratio)])
    top = steps.max()
    return float(min(1.0, np.exp(steps - top).sum() * math.exp(min(0.0, head + top)))) if head + top < 700 else 1.0


def certify(risk: float, error: float):
    """Choose the cut-off of one stratum and rule from its counts per cut-off, and name the strictest certified one."""
    def chosen(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        grid, best, strictest, gain = GRIDS[first.rule], None, None, 0.0
        good, bad = np.zeros(len(grid), np.int64), np.zeros(len(grid), np.int64)
        for step, g, b in zip(rows.step, rows.good, rows.bad, strict=True):
            if step < len(grid):  # above cut-off number step and all stricter ones
                good[step] += g
                bad[step] += b
        good, bad = np.cumsum(good), np.cumsum(bad)
        for k in range(len(grid)):
            if _tail(int(first.n_good), int(good[k]), risk / len(GRIDS)) > error / (len(GRIDS) * first.n_strata):
                break
            strictest = grid[k]
            if (now := bad[k] - COST * good[k]) > gain:
                best, gain = grid[k], now
        found = {"stratum": [first.stratum], "rule": [first.rule], "cutoff": [best], "strictest": [strictest], "n_good": [first.n_good]}
        return pd.DataFrame(found).astype({"cutoff": float, "strictest": float})

    return chosen


def cutoffs(labelled: DataFrame, risk: float = RISK, error: float = ERROR, least: int = LEAST) -> DataFrame:
    """(stratum, rule, cutoff) from labelled measures with columns stratum, good and the counts; a null cut-off rejects nothing."""
    size = labelled.groupBy("stratum").agg(F.sum(F.col("good").cast("long")).alias("n"))
    own = size.where(F.col("n") >= least).select("stratum", F.lit(True).alias("own"))
    steps = [
        F.struct(F.lit(rule).alias("rule"), _step(value, GRIDS[rule]).alias("step")) for rule, value in properties().items()
    ]
    counted = (
        labelled.join(own, "stratum", "left")
        .withColumn("stratum", F.explode(F.when(F.col("own"), F.array("stratum")).otherwise(F.array("stratum", F.lit(POOLED)))))
        .select("stratum", "good", F.explode(F.array(*steps)).alias("s"))
        .groupBy("stratum", "s.rule", "s.step")
        .agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    )
    counted = written(counted, "counted")
    totals = counted.groupBy("stratum", "rule").agg(F.sum("good").alias("n_good"))
    strata = counted.agg(F.count_distinct("stratum").alias("n_strata"))
    each = (
        counted.join(totals, ["stratum", "rule"]).join(F.broadcast(strata)).groupBy("stratum", "rule")
        .applyInPandas(certify(risk, error), "stratum string, rule string, cutoff double, strictest double, n_good bigint")
    )
    # a row per stratum and rule
    pooled = F.max(F.when(F.col("stratum") == POOLED, F.col("cutoff"))).over(Window.partitionBy("rule"))
    both = F.when(pooled.isNotNull() & F.col("strictest").isNotNull(), F.greatest(pooled, "strictest"))
    small = (F.col("n_good") < least) & (F.col("stratum") != POOLED)
    return each.select("stratum", "rule", F.when(small, both).otherwise(F.col("cutoff")).alias("cutoff"))


def _step(value, grid: list[float]):
    """Number of the loosest cut-off that the value exceeds; the grid's length where it exceeds none."""
    return F.lit(len(grid)) - F.size(F.filter(F.array(*map(F.lit, grid)), lambda x: value > x))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
           risk: float = RISK, error: float = ERROR, least: int = LEAST) -> DataFrame:
    """One row per document: its id, the counts, ``base_failed``, ``failed_rules`` and ``kept``.

    Labels are (id, quality), 1 being good; ids with a null or with both labels
    are not used. Null texts count nothing and fail the base rules; a null
    stratum is one of its own. Repeated rows are judged each. Other columns of
    the inputs are not looked at.
    """
    measures = written(
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
                    measured(F.col(text_col)).alias("m")).select("doc_id", "stratum", "m.*"),
        "quality",
    )
    by_stratum, one = _limits(measures, labels, id_col, risk, error, least)
    return (
        _verdict(measures, by_stratum, one)
        .select("doc_id", *COUNTS[:5], "base_failed", "kept", *COUNTS[5:], "failed_rules")
    )


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
         risk: float = RISK, error: float = ERROR, least: int = LEAST) -> DataFrame:
    """The documents, with all their columns, that ``judged`` keeps.

    Every row is measured once and kept beside its counts in the shared folder;
    cut-offs read the counts alone and the rows are filtered on the second
    read, so repeated and null ids and columns of any name do no harm.
    """
    rows = written(
        docs.select(
            F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"),
            F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), measured(F.col(text_col)).alias("m"),
        ).select("row", "stratum", "m.*"),
        "quality",
    )
    by_stratum, one = _limits(rows.select(F.col("row").getField(id_col).alias("doc_id"), "stratum", *COUNTS), labels, id_col, risk, error, least)
    return _verdict(rows, by_stratum, one).where("kept").select("row.*")


def _marks(labels: DataFrame, id_col: str) -> DataFrame:
    return (
        labels.select(F.col(id_col).alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
        .groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .where("low = high").select("doc_id", (F.col("low") == 1).alias("good"))
    )


def _limits(measures: DataFrame, labels: DataFrame, id_col: str, risk: float, error: float, least: int) -> tuple[DataFrame, DataFrame]:
    """Cut-offs per stratum, a handful of rows, and one row with the pooled ones."""
    holdout = measures.where(~base_failed()).join(_marks(labels, id_col), "doc_id")
    chosen = written(cutoffs(holdout, risk, error, least), "cutoffs")
    by_stratum = chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("own"))
    pooled = by_stratum.where(F.col("stratum") == POOLED).select(F.col("own").alias("pooled"))
    one = measures.sparkSession.range(1).join(pooled, how="left").select("pooled")  # one row, also without a pooled stratum
    return by_stratum, one


def _verdict(measures: DataFrame, by_stratum: DataFrame, one: DataFrame) -> DataFrame:
    limits = F.coalesce(F.col("own"), F.col("pooled"))
    failed = F.filter(
        F.array(*[F.when(value > F.element_at(limits, rule), F.lit(rule)) for rule, value in properties().items()]),
        lambda x: x.isNotNull(),
    )
    return (
        measures.join(by_stratum, "stratum", "left").join(F.broadcast(one))
        .withColumn("base_failed", base_failed()).withColumn("failed_rules", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") <= 0))
    )
