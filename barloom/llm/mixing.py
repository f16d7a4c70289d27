"""Mixing sources to target weights by balanced sampling with the cube method.

Every source is taken ``target / size`` times: the whole part as copies of all
its documents, the fraction as a balanced sample. The flight phase moves the
inclusion probabilities of three documents at a time along the null space of
two constraints, the number of documents and the number of words, until one is
0 or 1. Sources are split into blocks that fly by themselves; the one or two
undecided documents of each block fly again together, level by level, and only
those of a source's last block land, dropping the document count first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from barloom.llm.shared import written

#: weights by the order of sources, and how often a document may be taken at most
WEIGHTS, MOST = (5, 2, 1), 3
#: documents that fly together
BLOCK = 2000
SEED = 20240307
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One row per document: id, source, words of the text (0 in a null) and a hash that tells texts of one id apart."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(text_col)).alias("h"),
    )


def targets(measured: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, place, n, source_size, target): the weights share all words, no source over ``most`` times its own.

    Sorted by what a source can give for its weight, the sources at their limit
    come first; the level of the others is the largest quotient of what is left.
    One row per source goes through one task.
    """
    each = measured.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    each = each.withColumn("place", F.row_number().over(order))
    each = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int") + 1))
    each = each.withColumn("limit", (most * F.col("source_size")).cast("double"))
    rising = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    each = each.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return each.select("source", "place", "n", "source_size", F.least("limit", F.col("weight") * F.col("level")).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> None:
    """Move p until at most two documents are undecided, keeping its sum and that of p times size."""
    open_ = [k for k in range(len(p)) if 0.0 < p[k] < 1.0]
    draws = rng.random(len(open_) + 1).tolist()
    at, own = 0, []
    while True:
        while len(own) < 3 and at < len(open_):
            own.append(open_[at])
            at += 1
        sizes_ = [float(size[k]) for k in own]
        if len(own) == 3:
            move = [sizes_[2] - sizes_[1], sizes_[0] - sizes_[2], sizes_[1] - sizes_[0]]
            if not any(move):
                move = [1.0, -1.0, 0.0]
        elif len(own) == 2 and sizes_[0] == sizes_[1]:
            move = [1.0, -1.0]
        else:
            return
        _step(p, own, move, draws.pop())
        own = [k for k in own if 0.0 < p[k] < 1.0]


def _step(p: np.ndarray, own: list[int], move: list[float], draw: float) -> None:
    up = min((1 - p[k]) / m if m > 0 else -p[k] / m for k, m in zip(own, move, strict=True) if m)
    down = min(p[k] / m if m > 0 else (p[k] - 1) / m for k, m in zip(own, move, strict=True) if m)
    far = up if draw * (up + down) < down else -down
    for k, m in zip(own, move, strict=True):
        p[k] += far * m
        if p[k] < 1e-9:
            p[k] = 0.0
        elif p[k] > 1 - 1e-9:
            p[k] = 1.0


def landing(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> None:
    """Decide the last documents: two against each other by words, the last by its probability."""
    own = [k for k in range(len(p)) if 0.0 < p[k] < 1.0]
    if len(own) == 2:
        _step(p, own, [float(size[own[1]]), -float(size[own[0]])], rng.random())
        own = [k for k in own if 0.0 < p[k] < 1.0]
    for k in own:
        p[k] = float(rng.random() < p[k])


def fly(level: int):
    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["turn", "doc_id", "h", "size"], kind="stable")
        p, size = rows["p"].to_numpy().copy(), rows["size"].to_numpy()
        rng = np.random.default_rng([SEED, level, int(rows["place"].iloc[0]), int(rows["block"].iloc[0])])
        flight(p, size, rng)
        if rows["blocks"].iloc[0] == 1:
            landing(p, size, rng)
        return rows.assign(p=p)

    return block


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, copies, h) of every row; ``copies`` is how often the mix takes it.

    Texts without words are never taken. A null source is one source, the last.
    Repeated rows are drawn each. The same rows give the same mix; other columns
    are not looked at. An empty table gives no rows.
    """
    measured = written(sizes(docs, id_col, text_col, source_col), "sizes")
    found = written(targets(measured, weights, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = (
        measured.alias("m").join(found.alias("t"), F.col("m.source").eqNullSafe(F.col("t.source")))
        .select("doc_id", "h", "size", "source_size", "target", "place", "n", F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("p"))
        .withColumn("p", F.when(F.col("size") > 0, F.col("p")).otherwise(F.lit(0.0)))
        .withColumn("turn", F.xxhash64("doc_id", "h", F.lit(SEED)))
    )
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    results = [rows.where(~open_)]
    waiting, n, level = rows.where(open_), F.col("n"), 0
    most_rows = found.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    while most_rows:
        blocks = -(-most_rows // BLOCK)
        waiting = waiting.withColumn("blocks", F.ceil(n / BLOCK).cast("long")).withColumn("block", F.pmod("turn", "blocks"))
        waiting = written(waiting.groupBy("place", "block").applyInPandas(fly(level), waiting.schema), "flight")
        results.append(waiting.where(~open_).drop("blocks", "block"))
        if blocks == 1:
            break
        waiting = waiting.where(open_).drop("n").join(
            waiting.where(open_).groupBy("place").agg(F.count("*").alias("n")), "place",
        ).withColumn("turn", F.xxhash64("turn", F.lit(level))).select(*rows.columns)
        most_rows = waiting.groupBy("place").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        level += 1
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("long")).alias("copies"), "h")


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents, with all columns, each as often as the mix takes it; equal rows of one id count together."""
    drawn = mix(docs, id_col, text_col, source_col, **options).where("copies > 0").groupBy("doc_id", "h").agg(F.sum("copies").cast("int").alias("copies"))
    rows = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"))
    place = F.row_number().over(Window.partitionBy("id", "th").orderBy("id"))
    joined = rows.join(drawn, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("th") == F.col("h")))
    return joined.withColumn("place", place).where("place = 1").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
