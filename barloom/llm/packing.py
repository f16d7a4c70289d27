"""Best-fit packing of token sequences, improved by bin completion.

Lengths are whole numbers up to the capacity, so how the pieces fill sequences
depends on the number of pieces of each length only: one histogram of at most
``capacity`` rows, whatever the size of the corpus. Best-fit decreasing on it is
the incumbent. If it needs more sequences than the lower bound, bin completion
searches by branch and bound: around the largest length left it branches over the
undominated fillings, least waste first, and over how often each is used, and
steps back from a branch whose waste exceeds what a better packing could have.
It ends with an optimal packing, or keeps the best one known where ``NODES``
fillings were tried for one number of sequences. The plan, groups of equally filled sequences, is then dealt to the
pieces by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from barloom.llm.encode import encoded
from barloom.llm.shared import written

CAPACITY = 2048
#: pieces of one length that are ranked in one task; steps of the search for one number of sequences, and fillings a branch holds
RANKED, NODES, BATCH = 50_000, 20_000, 64

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, path: str, end: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every document: its ids and an end id, cut from the back so that only the first piece is short."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            rows: list[list] = [[], [], [], [], []]
            for first, ids, begins in encoded(batch.column(1), path):
                for i in range(len(begins) - 1):
                    own = np.append(ids[begins[i] : begins[i + 1]], end).astype("<u4")
                    size = (len(own) - 1) % capacity + 1
                    start = 0
                    for k in range(-(-len(own) // capacity)):
                        stop = size + k * capacity
                        for column, value in zip(rows, (names[first + i], k, start, stop - start, zlib.crc32(own[start:stop].tobytes())), strict=True):
                            column.append(value)
                        start = stop
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(x, t) for x, t in zip(rows, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, PIECES)


Groups = list[tuple[int, list[tuple[int, int]]]]


def best_fit(counts: dict[int, int], capacity: int) -> Groups:
    """Groups of (sequences, [(length, how many in each)]) by best-fit decreasing."""
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            free = min((r for r, own in room.items() if r >= length and own), default=None)
            if free is None:
                number, items, free = left, [], capacity
                each = min(left, capacity // length)
                number = left // each
            else:
                number, items = room[free].pop()
                each = min(left, free // length)
                if left < number * each:
                    fewer = left // each
                    room[free].append((number - fewer, items))
                    number = fewer
            left -= number * each
            room.setdefault(free - each * length, []).append((number, [*items, (length, each)]))
    return [group for own in room.values() for group in own]


def least(counts: dict[int, int], capacity: int) -> int:
    """A lower bound on the sequences: pieces over half the capacity need one each, and smaller ones fill only what these leave."""
    lengths = np.array(sorted(counts), np.int64)
    number = np.array([counts[int(k)] for k in lengths], np.int64)
    bound = 0
    for small in {0, *(int(k) for k in lengths if 2 * k <= capacity)}:
        alone, large = lengths > capacity - small, (2 * lengths > capacity) & (lengths <= capacity - small)
        rest = (2 * lengths <= capacity) & (lengths >= small)
        room = int(((capacity - lengths) * number)[large].sum())
        over = int((lengths * number)[rest].sum()) - room
        bound = max(bound, int(number[alone | large].sum()) + max(0, -(-over // capacity)))
    return bound


def fillings(space: int, below: int, counts: dict[int, int], spare: int, budget: list[int]) -> Iterator[tuple[int, tuple[tuple[int, int], ...]]]:
    """(waste, items) of the undominated fillings of a space beside one piece ``below``, by waste and then from the largest lengths on.

    A filling is dominated where a piece that is left can take the place of none,
    one or several of its items whose sum is smaller, or of several of equal sum:
    these then fit where that piece was. Sums are bits of whole numbers.
    """
    lengths = sorted((k for k in counts if k <= space), reverse=True)
    many = [counts[k] - (k == below) for k in lengths]
    reach = [1] * (len(lengths) + 1)  # sums that the lengths from this one on can make
    for k in range(len(lengths) - 1, -1, -1):
        sums, left, part = reach[k + 1], min(many[k], space // lengths[k]), 1
        while left > 0:
            part = min(part, left)
            sums |= sums << part * lengths[k]
            left -= part
            part *= 2
        reach[k] = sums & ((2 << space) - 1)
    stock = sum(1 << length for length, n in zip(lengths, many, strict=True) if n)
    of = dict(zip(lengths, many, strict=True))

    def exact(k: int, left: int, items: tuple[tuple[int, int], ...]) -> Iterator[tuple[tuple[int, int], ...]]:
        if not left:
            yield items
            return
        while reach[k] >> left & 1:
            for n in range(min(many[k], left // lengths[k]), 0, -1):
                if reach[k + 1] >> left - n * lengths[k] & 1:
                    yield from exact(k + 1, left - n * lengths[k], (*items, (lengths[k], n)))
            k += 1

    def dominated(items: tuple[tuple[int, int], ...], waste: int) -> bool:
        free, one, more = stock, 0, 0
        for length, n in items:
            if of[length] == n:
                free ^= 1 << length
            for _ in range(n):
                more |= (more | one) << length
                one |= 1 << length
        wide, span = (1 | one | more) << 1 if waste else 0, 1
        while span < waste:
            step = min(span, waste - span)
            wide |= wide << step
            span += step
        return bool(free & (wide | more))

    for waste in range(min(space, spare) + 1):
        if reach[0] >> space - waste & 1:
            for items in exact(0, space - waste, ()):
                budget[0] -= 1
                if budget[0] < 0:
                    return
                if not dominated(items, waste):
                    yield waste, items


class Branch:
    """The sequences around one largest length: the filling now tried, how often, and those that were tried before it."""

    def __init__(self, largest: int, tried: frozenset) -> None:
        self.largest, self.tried = largest, tried
        self.batch: list[tuple[int, tuple[tuple[int, int], ...]]] = []
        self.seen, self.times, self.waste = 0, 0, 0
        self.need: dict[int, int] = {}

    def choose(self, counts: dict[int, int], capacity: int, spare: int, budget: list[int]) -> bool:
        """Take the next filling. All sequences around this length waste as much or more, so too much for one ends the branch."""
        while True:
            if not self.batch:  # made anew from the same counts, so that deep branches hold a few fillings only
                own = fillings(capacity - self.largest, self.largest, counts, spare, budget)
                self.batch = list(islice(own, self.seen, self.seen + min(max(1, self.seen), BATCH)))
                self.seen += len(self.batch)
                if not self.batch:
                    return False
            self.waste, items = self.batch.pop(0)
            if -(-counts[self.largest] // (capacity // self.largest)) * self.waste > spare:
                return False
            if items in self.tried:
                continue
            self.tried |= {items}
            self.need = {self.largest: 1}
            for length, number in items:
                self.need[length] = self.need.get(length, 0) + number
            self.times = min(counts[k] // n for k, n in self.need.items())
            return True


def complete(counts: dict[int, int], capacity: int, most: int, budget: list[int]) -> tuple[Groups | None, bool]:
    """A packing into at most ``most`` sequences, and whether the search came to its end.

    Depth first over the fillings of the largest length left and over how often
    each is used; a step back wherever the waste exceeds what ``most`` allows.
    (None, True) proves that there is none, (None, False) says that the budget of
    fillings was spent.
    """
    counts = dict(counts)
    spare = most * capacity - sum(k * n for k, n in counts.items())
    if spare < 0 or not counts:
        return (None if spare < 0 else []), True
    stack = [Branch(max(counts), frozenset())]
    while stack:
        now = stack[-1]
        if now.times:  # back from below: the same filling once less
            for k, n in now.need.items():
                counts[k] = counts.get(k, 0) + now.times * n
            spare += now.times * now.waste
            now.times -= 1
        if not now.times and not now.choose(counts, capacity, spare, budget):
            stack.pop()
            if budget[0] < 0:
                return None, False
            continue
        budget[0] -= 1
        if budget[0] < 0:
            return None, False
        for k, n in now.need.items():
            counts[k] -= now.times * n
            if not counts[k]:
                del counts[k]
        spare -= now.times * now.waste
        if not counts:
            return [(b.times, sorted(b.need.items(), reverse=True)) for b in stack], True
        stack.append(Branch(max(counts), now.tried if now.largest in counts else frozenset()))
    return None, True


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Groups:
    """How the lengths fill sequences: the incumbent, or what bin completion finds below it.

    The search begins at the lower bound. A number of sequences that is proved
    too small raises the bound by one; where its share of ``nodes`` is spent
    first, half of the way to the incumbent is tried next. Without a spent share
    the plan is optimal.
    """
    found = best_fit(counts, capacity)
    now, target = sum(n for n, _ in found), least(counts, capacity) if counts else 0
    while target < now:
        better, ended = complete(counts, capacity, target, [nodes])
        if better is not None:
            found, now = better, sum(n for n, _ in better)
        elif ended:
            target += 1
        else:
            target += max(1, (now - target) // 2)
    return found


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows with a column ``length`` and (doc_id, piece, start), with their sequence_id and offset added.

    Lengths are between 1 and the capacity. Equal rows get places of their own,
    whatever their ids; an empty table stays empty. Other columns stay, whatever
    their names; a sequence_id and an offset of before are replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop("sequence_id", "offset")
    rows = written(rows.select(F.struct(*[F.col(f"`{x}`") for x in rows.columns]).alias("row"), "length", "doc_id", "piece", "start"), "pieces")
    by_length = rows.groupBy("length").agg(F.count("*").alias("of_length"))
    counts = {r.length: r.of_length for r in by_length.collect()}  # at most one row per length up to the capacity
    starts, first, each, sequence, offset = [], [], [], [], []
    used: dict[int, int] = {}
    done = 0
    for number, items in plan(counts, capacity):
        at = 0
        for length, many in items:
            starts.append(length << 44 | used.get(length, 0))
            first.append(used.get(length, 0))
            each.append(many)
            sequence.append(done)
            offset.append(at)
            used[length] = used.get(length, 0) + number * many
            at += length * many
        done += number
    order = np.argsort(np.array(starts, np.int64)) if starts else np.zeros(0, np.int64)
    tables = spark.sparkContext.broadcast([np.array(x, np.int64)[order] for x in (starts, first, each, sequence, offset)])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, first, each, sequence, offset = tables.value
        for batch in batches:
            length, rank = (batch.column(x).to_numpy() for x in ("length", "rank"))
            at = np.searchsorted(starts, (length << 44) + rank, "right") - 1
            turn = rank - first[at]
            yield pa.record_batch(
                [batch.column("row"), pa.array(sequence[at] + turn // each[at]), pa.array(offset[at] + turn % each[at] * length)],
                ["row", "sequence_id", "offset"],
            )

    salted = rows.join(F.broadcast(by_length), "length").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece", "start", F.lit(1)), F.col("of_length") / RANKED + 1).cast("long"))
    cell = Window.partitionBy("length", "salt")
    before = (
        salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    )
    ranked = salted.withColumn("own", F.row_number().over(cell.orderBy("doc_id", "piece", "start")))
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    schema = StructType([rows.schema["row"], StructField("sequence_id", LongType()), StructField("offset", LongType())])
    dealt = ranked.select("row", "length", F.col("rank").cast("long").alias("rank")).mapInArrow(placed, schema)
    return dealt.select("row.*", "sequence_id", "offset")
