"""Trie of the shared beginnings of conversations, built as a burst trie.

A conversation is the string of its turns. All strings start in one container
under the root. A container that holds too many turns bursts: its head becomes
a node and its strings are dealt into new containers by their next turn. Equal
strings are one string with its number of copies, and every round is a join and
an aggregation over all containers that still burst. What remains are small
containers under the heads: each is sorted and swept into its nodes by one pass
with a stack, containers of one string become a chain of nodes without a sweep.
Leaves and savings of a head are the sums over the containers and heads below it.

Turns are known by two 64-bit hashes. No task holds a conversation: turns are
numbered over range partitions, and what is counted before a partition is added
for the conversations that cross its border.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from barloom.llm.shared import written

#: fixed values of the rebuilding rule: conversations that share a beginning, and the divisor of its length
FAMILY, BEGINNINGS = 5, 9
#: turns that a container may hold, ids in one piece of a list of members, turns summed at once in a long chain
CONTAINER, PIECE, STRETCH = 1024, 1 << 16, 1024

NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ended bigint, ended_m bigint"


# --- turns and their places


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the number of each turn of a conversation within it."""
    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        ids = batch.column(0).to_numpy()
        if not len(ids):
            continue
        new = np.append(True, ids[1:] != ids[:-1])
        place = np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
        if last is not None and ids[0] == last:
            place[: int(np.argmin(ids == last)) if (ids != last).any() else len(ids)] += count
        last, count = ids[-1], int(place[-1]) + 1
        yield pa.record_batch([pa.array(np.full(len(ids), part)), pa.array(place), *batch.columns], ["part", "place", *batch.schema.names])


def turns_in_place(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, bytes): every turn with its place and hashes; a row without a conversation belongs to none.

    Order is by turn, null first; equal turns stand in the order of role and text.
    """
    def text(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    rows = (
        conversations.where(F.col("conv_id").isNotNull())
        .select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "role", "text").alias("b"), F.octet_length("text").cast("bigint").alias("bytes"))
    placed = written(sorted_rows.mapInArrow(_numbers, "part bigint, place bigint, conv_id bigint, a bigint, b bigint, bytes bigint"), "turns")
    # only the first and the last conversation of a partition can go on in another one
    borders = placed.groupBy("part").agg(F.array(F.min("conv_id"), F.max("conv_id")).alias("ids")).select(F.explode("ids").alias("conv_id")).distinct()
    counts = placed.join(F.broadcast(borders), "conv_id", "left_semi").groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # two rows a partition at most
    return placed.join(F.broadcast(before), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "a", "b", "bytes")


def rebuilt(turns: DataFrame, family: int = FAMILY, beginnings: int = BEGINNINGS) -> tuple[DataFrame, DataFrame]:
    """(ids of all conversations, their rebuilt turns)."""
    ids = turns.select("conv_id").distinct()
    head = turns.where(F.col("pos") < beginnings - 1)
    plan = ids.select(
        "conv_id", (F.crc32(F.col("conv_id").cast("string")) % beginnings).alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    has = head.groupBy("conv_id").agg(F.count("*").alias("has")).withColumnRenamed("conv_id", "base")
    plan = written(plan.join(has, "base", "left").select("conv_id", "h", "base", F.least("h", F.coalesce("has", F.lit(0))).alias("taken")), "plan")
    given = head.withColumnRenamed("conv_id", "base").join(plan, "base").where("pos < h").select("conv_id", "pos", "a", "b", "bytes")
    own = turns.join(plan, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "a", "b", "bytes")
    return plan.select("conv_id"), written(given.unionByName(own), "rebuilt")


# --- containers


def _sweep(rows: dict[str, list], at: int, stop: int, out: dict[str, list]) -> None:
    """Nodes of one container: rows of its strings from its head's last turn on, by string and place."""
    strings = []
    while at < stop:
        s, end = rows["s"][at], at + 1
        while end < stop and rows["s"][end] == s:
            end += 1
        strings.append(([(rows["a"][i], rows["b"][i]) for i in range(at, end)], rows["bytes"][at:end], s, rows["m"][at]))
        at = end
    strings.sort(key=lambda x: x[0])
    depth, parent, path = rows["depth"][at - 1], rows["parent"][at - 1], rows["path"][at - 1]
    nodes: list[list] = []  # first string, copies, children, leaves, saved, ended, copies that end, bytes, number of the parent
    stack: list[int] = []
    before: list = []
    for turns, sizes, s, m in strings:
        same = 0
        while same < min(len(turns), len(before)) and turns[same] == before[same]:
            same += 1
        del stack[same:]
        for k in range(same, len(turns)):
            if stack:
                nodes[stack[-1]][2] += 1
            nodes.append([s, 0, 0, 0, 0, None, 0, sizes[k], stack[-1] if stack else -1])
            stack.append(len(nodes) - 1)
        for k in stack:
            nodes[k][0] = min(nodes[k][0], s)
            nodes[k][1] += m
        nodes[stack[-1]][5:7] = [s, m]
        before = turns
    level = [0] * len(nodes)
    for k, node in enumerate(nodes):
        level[k] = level[node[8]] + 1 if node[8] >= 0 else depth
    for k in range(len(nodes) - 1, -1, -1):  # a parent has a smaller number than its children
        node = nodes[k]
        node[3] += node[2] == 0
        node[4] += (node[1] - 1) * node[7]
        if node[8] >= 0:
            nodes[node[8]][3] += node[3]
            nodes[node[8]][4] += node[4]
    for k, node in enumerate(nodes):
        values = (node[0], level[k], nodes[node[8]][0] if node[8] >= 0 else parent, *node[1:7], path if node[8] < 0 else None)
        for column, value in zip(out.values(), values, strict=True):
            column.append(value)


SWEPT = [x.split()[0] for x in NODE.split(", ")] + ["path"]


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweeps the containers of a stream sorted by container, string and place; what is held is one container and a batch."""
    def done(table: pa.Table) -> pa.RecordBatch:
        rows, out = table.to_pydict(), {x: [] for x in SWEPT}
        edges = [i for i in range(len(table)) if not i or (rows["k1"][i], rows["k2"][i]) != (rows["k1"][i - 1], rows["k2"][i - 1])] + [len(table)]
        for at, stop in zip(edges, edges[1:], strict=False):
            _sweep(rows, at, stop, out)
        arrays = [pa.array(x, pa.list_(pa.int64()) if name == "path" else pa.int64()) for name, x in out.items()]
        return pa.record_batch(arrays, SWEPT)

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if not len(table):
            continue
        k1, k2 = table.column("k1").to_numpy(), table.column("k2").to_numpy()
        last = len(table) - int(np.argmin(((k1 == k1[-1]) & (k2 == k2[-1]))[::-1])) if ((k1 != k1[-1]) | (k2 != k2[-1])).any() else 0
        if last:
            yield done(table.slice(0, last))
        held = table.slice(last)
    if held is not None and len(held):
        yield done(held)


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the lists of members from a stream sorted by string and id."""
    for batch in batches:
        s, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out, at = ([], [], []), 0
        while at < len(s):
            end = at + 1
            while end < len(s) and s[end] == s[at] and end - at < PIECE:
                end += 1
            for column, value in zip(out, (s[at], ids[at], ",".join(map(str, ids[at:end]))), strict=True):
                column.append(value)
            at = end
        yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["s", "first", "piece"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each string, one after another."""
    now, state = None, None
    for batch in batches:
        found = []
        for s, piece in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            if s != now:
                if state is not None:
                    found.append((now, state.hexdigest()))
                now, state = s, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.as_buffer())
        yield pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], ["s", "sha"])
    if state is not None:
        yield pa.record_batch([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], ["s", "sha"])


def trie(conversations: DataFrame, container: int = CONTAINER) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Null roles and texts are empty, a null turn stands first, equal turns stand
    in the order of role and text, repeated rows are repeated turns. Rows with
    a null conv_id belong to no conversation; no conversation, no root. Other
    columns are not looked at.
    """
    ids, turns = rebuilt(turns_in_place(conversations))
    whole = turns.groupBy("conv_id").agg(
        F.count("*").alias("len"), F.bit_xor(F.xxhash64("pos", "a", "b")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "pos", "b", "a")).alias("y"))
    each = written(ids.join(whole, "conv_id", "left").select("conv_id", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("len", "x", "y")]), "whole")
    strings = written(each.groupBy("len", "x", "y").agg(F.min("conv_id").alias("s"), F.count("*").alias("m")), "strings")
    letters = written(
        turns.withColumnRenamed("conv_id", "s").join(strings.select("s"), "s", "left_semi").select("s", "pos", "a", "b", "bytes")
        # the root's own row, without a text
        .unionByName(strings.select("s", F.lit(-1).cast("bigint").alias("pos"), *[F.lit(0).cast("bigint").alias(x) for x in ("a", "b", "bytes")])),
        "letters",
    )
    heads, small = _burst(strings, letters, container)
    alone = small.where("n_strings = 1")
    many = small.where("n_strings > 1")
    rows = letters.join(many.drop("bytes"), "s").where("pos >= depth - 1").select("k1", "k2", "depth", "parent", "path", "s", "m", "pos", "a", "b", "bytes")
    swept = rows.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "s", "pos").mapInArrow(_swept, NODE + ", path array<bigint>")
    below = written(swept.unionByName(_chains(letters, alone)), "nodes")
    nodes = below.drop("path").unionByName(_head_nodes(heads, below))
    return _with_digests(nodes, each, strings)


def _burst(strings: DataFrame, letters: DataFrame, container: int) -> tuple[DataFrame, DataFrame]:
    """(heads of the containers that burst, strings with the container that they remain in)."""
    state = strings.select(
        "s", "len", "m", *[F.lit(0).cast("bigint").alias(x) for x in ("k1", "k2", "bytes")], F.lit(None).cast("bigint").alias("parent"),
        F.array().cast("array<bigint>").alias("path"))
    depth, heads, small = 0, [], []
    while True:
        sizes = state.groupBy("k1", "k2").agg(
            F.sum(F.col("len") - depth + 1).alias("turns"), F.count("*").alias("n_strings"), F.min("s").alias("first"), F.sum("m").alias("n_convs"))
        state = written(state.join(sizes, ["k1", "k2"]).withColumn("depth", F.lit(depth).cast("bigint")), "containers")
        bursts = state.where((F.col("turns") > container) & (F.col("n_strings") > 1))
        small.append(state.where(~((F.col("turns") > container) & (F.col("n_strings") > 1))))
        if bursts.isEmpty():
            break
        ended = F.col("len") == depth
        heads.append(bursts.groupBy("k1", "k2").agg(
            F.first("first").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent_conv_id"), F.first("n_convs").alias("n_convs"),
            F.first("bytes").alias("bytes"), F.first("path").alias("path"), F.max(F.when(ended, F.col("s"))).alias("ended"), F.max(F.when(ended, F.col("m"))).alias("ended_m")))
        nexts = letters.where(F.col("pos") == depth).select("s", "a", "b", F.col("bytes").alias("size"))
        state = bursts.where(F.col("len") > depth).join(nexts, "s").select(
            "s", "len", "m", F.xxhash64("k1", "a", "b").alias("k1"), F.xxhash64("k2", "b", "a").alias("k2"), F.col("size").alias("bytes"),
            F.col("first").alias("parent"), F.array_append("path", F.col("first")).alias("path"))
        depth += 1
    remaining = small[0]
    for more in small[1:]:
        remaining = remaining.unionByName(more)
    found = None
    for more in heads:
        found = more if found is None else found.unionByName(more)
    return (None if found is None else written(found.drop("k1", "k2"), "heads")), remaining


def _chains(letters: DataFrame, alone: DataFrame) -> DataFrame:
    """Nodes of the containers of one string: each has one child but the last, which is the leaf."""
    rows = letters.join(alone.drop("bytes"), "s").where("pos >= depth - 1").select(
        "s", "m", "len", F.col("depth").alias("top"), "parent", "path", "pos", F.col("bytes").alias("size"))
    once = rows.where("m = 1").withColumn("rest", F.lit(0).cast("bigint"))
    # of copied strings the bytes from here to the end, by stretches, so that no task holds a long one
    copied = rows.where("m > 1").withColumn("stretch", F.floor(F.col("pos") / STRETCH))
    later = Window.partitionBy("s").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    after = copied.groupBy("s", "stretch").agg(F.sum("size").alias("t")).select("s", "stretch", F.coalesce(F.sum("t").over(later), F.lit(0)).alias("after"))
    own = Window.partitionBy("s", "stretch").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    copied = copied.withColumn("own", F.sum("size").over(own)).join(after, ["s", "stretch"]).withColumn("rest", F.col("own") + F.col("after")).drop("stretch", "own", "after")
    top, leaf = F.col("pos") == F.col("top") - 1, F.col("pos") == F.col("len") - 1
    return once.unionByName(copied).select(
        F.col("s").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.when(top, F.col("parent")).otherwise(F.col("s")).alias("parent_conv_id"),
        F.col("m").alias("n_convs"), F.when(leaf, 0).otherwise(1).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        ((F.col("m") - 1) * F.col("rest")).alias("saved_tokens"), F.when(leaf, F.col("s")).alias("ended"), F.when(leaf, F.col("m")).alias("ended_m"),
        F.when(top, F.col("path")).alias("path"))


def _head_nodes(heads: DataFrame | None, below: DataFrame) -> DataFrame:
    """Nodes of the heads: children, leaves and savings summed from what hangs below them."""
    columns = [x.split()[0] for x in NODE.split(", ")]
    if heads is None:
        return below.drop("path").limit(0)
    own = ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")
    parts = (
        below.where("path is not null").select("path", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.lit(0).alias("itself"))
        .unionByName(heads.select(F.array_append("path", F.col("conv_id")).alias("path"), F.lit(0).cast("bigint").alias("leaves"), own, F.lit(1).alias("itself")))
    )
    last = F.col("depth") == F.size("path") - 1 - F.col("itself")
    sums = (
        parts.select("*", F.posexplode("path").alias("depth", "conv_id")).groupBy("depth", "conv_id")
        .agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.sum(last.cast("bigint")).alias("n_children"))
    )
    return heads.join(sums.withColumn("depth", F.col("depth").cast("bigint")), ["depth", "conv_id"]).select(*columns)


def _with_digests(nodes: DataFrame, each: DataFrame, strings: DataFrame) -> DataFrame:
    """Adds ``ends_sha256``: the members that end at a node are the copies of one string."""
    one = F.when(F.col("ended").isNull(), F.lit("")).when(F.col("ended_m") == 1, F.col("ended").cast("string"))
    nodes = written(nodes.withColumn("ends_sha256", F.sha2(one, 256)), "nodes")
    members = each.join(strings.where("m > 1").select("len", "x", "y", "s"), ["len", "x", "y"]).select("s", "conv_id")
    pieces = members.repartitionByRange("s", "conv_id").sortWithinPartitions("s", "conv_id").mapInArrow(_ids, "s bigint, first bigint, piece string")
    digests = pieces.repartition("s").sortWithinPartitions("s", "first").mapInArrow(_digests, "s bigint, sha string")
    copied = nodes.where("ends_sha256 is null").join(digests.withColumnRenamed("s", "ended"), "ended").withColumn("ends_sha256", F.col("sha")).drop("sha")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return nodes.where("ends_sha256 is not null").select(columns).unionByName(copied.select(columns))
