"""Code lengths of texts under a context-tree weighting model learned from the other documents.

A text is its UTF-8 bytes, lower-cased in A-Z, and an end. Every byte is eight
binary decisions; each decision has a context tree of its own over the bytes
before it, most recent first. A node holds the Krichevsky-Trofimov estimate of
the decisions seen in its context, and weighs it against what its children say:
``P(node) = (KT(node) + product of P(children)) / 2``. So a decision's
probability mixes the estimates of all depths, each by its share of the
weighted probability. The counts come from all training texts.

All that a text needs of the model is the probability of each of its distinct
grams (a context and its byte), so no tree is ever whole in one place. Blocks
of texts ask for their distinct grams and words, with the counts of their
training rows, once per block; buckets of contexts that share their two most
recent bytes add the counts up, build their subtrees and answer; the levels
above, at most 256 x 255 nodes, come from exact sums over all buckets. Counts of
words for the base score take the same way.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from barloom.llm.shared import written
from barloom.llm.words import LOWER, MULTIPLIER, SEPARATOR, Spans, chunks, mixed

#: bytes of context, at most 7; the divisor and the remainder of the documents held out
DEPTH, FOLDS, HELD_OUT = 5, 7, 2
#: bytes of text in a block, bytes of text per bucket, grams whose subtrees are built at once
BLOCK, BUCKET, SLICE = 1 << 22, 1 << 24, 1 << 18
END = 0xFF  # occurs in no UTF-8 text
#: sums of logarithms over buckets are exact in these fractions
FRACTION = 1 << 16
GRAMS, WORDS, TEXT = 0, 1, 2


# --- numbers


def _pack(values: np.ndarray) -> bytes:
    """Compressed planes of the bytes of 64-bit integers."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=np.uint64(0)))


def _unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob), dtype=np.uint64)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function from 0.5 on."""
    product = np.ones_like(x)
    for k in range(8):
        product *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class Places:
    """Where each of many keys stands among distinct ones, by a few tables of hashed slots."""

    def __init__(self, distinct: np.ndarray) -> None:
        self.distinct, self.tables = distinct, []
        left, bits = np.arange(len(distinct)), max(8, int(4 * len(distinct) + 1).bit_length())
        while len(left):
            factor = np.uint64(MULTIPLIER + 2 * len(self.tables) * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF | 1)
            slots = (distinct[left] * factor) >> np.uint64(64 - bits)
            table = np.zeros(1 << bits, np.int32)
            table[slots] = left
            self.tables.append((factor, np.uint64(64 - bits), table))
            left = left[table[slots] != left]
            bits = max(8, bits - 3)

    def of(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), np.int32)
        open_ = None
        for factor, shift, table in self.tables:
            own = keys if open_ is None else keys[open_]
            at = table[(own * factor) >> shift]
            wrong = np.flatnonzero(self.distinct[at] != own)
            if open_ is None:
                found, open_ = at, wrong
            else:
                found[open_] = at
                open_ = open_[wrong]
            if not len(open_):
                break
        return found


# --- blocks of texts


class Block:
    """Pieces of texts as one stream of bytes: before each piece its context, behind a text's last piece its end."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, last: np.ndarray, before: np.ndarray, held: np.ndarray) -> None:
        self.sizes, self.last, self.held = sizes, last, held
        extra = DEPTH + last.astype(np.int64)
        self.stops = np.cumsum(sizes + extra)
        starts = self.stops - sizes - extra + DEPTH  # of the texts' own bytes
        self.stream = np.full(int(self.stops[-1]) if len(sizes) else 0, END, np.uint8)
        offsets = np.append(0, np.cumsum(sizes))
        lower = LOWER[data]
        for to, a, b in zip(starts.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            self.stream[to : to + b - a] = lower[a:b]
        for k in range(DEPTH):
            self.stream[starts - DEPTH + k] = before[:, k]
        self.starts, self.data, self.offsets = starts, data, offsets

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """The gram of every byte that is coded, most recent byte of the context first, and the number of grams of each piece."""
        n = len(self.stream)
        keys = self.stream.astype(np.uint64)
        part = np.empty(max(n - DEPTH, 0), np.uint64)
        for back in range(1, DEPTH + 1):
            part[:] = self.stream[DEPTH - back : n - back]
            part <<= np.uint64(8 * (DEPTH + 1 - back))
            keys[DEPTH:] |= part
        del part
        coded = np.ones(n, bool)
        for k in range(1, DEPTH + 1):
            coded[self.starts - k] = False
        return keys[coded], self.sizes + self.last

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """The hash of every word and the number of words of each piece; pieces end between words."""
        spans = Spans(self.data, self.offsets, lower=True)
        return spans.hashes(spans.starts, spans.ends), spans.counts


def _counted(keys: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each is learned from."""
    own, n = np.unique(keys[learned], return_counts=True)
    rest = np.unique(keys[~learned])
    if not len(rest):
        return own, n
    distinct = np.union1d(own, rest)
    counts = np.zeros(len(distinct), np.int64)
    counts[np.searchsorted(distinct, own)] = n
    return distinct, counts


def _bucket(kind: int, keys: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of sorted keys: grams by their two most recent bytes, words by their hash."""
    if kind == GRAMS:
        top = np.arange(1 << 16, dtype=np.uint64)
        return (mixed(top + np.uint64(1)) >> np.uint64(64 - bits)).astype(np.uint16)[(keys >> np.uint64(8 * (DEPTH - 1))).astype(np.int64)]
    return (keys >> np.uint64(64 - bits)).astype(np.uint16)


def _by_bucket(kind: int, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted keys by bucket, and their buckets in that order."""
    buckets = _bucket(kind, keys, bits)
    order = np.argsort(buckets, kind="stable")
    return order, buckets[order]


def _pieces(batch: pa.RecordBatch, first_row: int, block: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(rows, bytes, sizes, last, before) of blocks of a batch; a text longer than a block is cut behind a separator."""
    for row, data, offsets in chunks(batch.column(1), block):
        if len(data) <= block:
            n = len(offsets) - 1
            yield np.arange(row, row + n) + first_row, data, np.diff(offsets), np.ones(n, bool), np.full((n, DEPTH), END, np.uint8)
            continue
        at, before = 0, np.full((1, DEPTH), END, np.uint8)  # one long text
        while at < len(data):
            stop = min(at + block, len(data))
            if stop < len(data):
                inside = np.flatnonzero(SEPARATOR[data[at:stop]])
                if len(inside):
                    stop = at + int(inside[-1]) + 1
                else:  # a word longer than a block stays whole
                    gap = next((k for k in range(stop, len(data), block) if SEPARATOR[data[k : k + block]].any()), None)
                    stop = len(data) if gap is None else gap + int(np.argmax(SEPARATOR[data[gap : gap + block]])) + 1
            part = data[at:stop]
            yield np.array([row + first_row]), part, np.array([len(part)]), np.array([stop == len(data)]), before
            before = np.concatenate([before[0], LOWER[part[-DEPTH:]]])[-DEPTH:][None]
            at = stop


REQUESTS = "kind int, bucket int, block bigint, a binary, b binary"


def _requests(block: int, bits: int, folds: int, held_out: int):
    """What each block of a task asks for, and its texts."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, first_row = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            ids = batch.column(0)
            for row, data, sizes, last, before in _pieces(batch, first_row, block):
                own = [ids[int(i) - first_row].as_py() for i in row]
                held = np.array([zlib.crc32(b"" if x is None else b"%d" % x) % folds == held_out for x in own])
                texts = Block(data, sizes, last, before, held)
                out = []
                for kind, made in ((GRAMS, texts.grams), (WORDS, texts.words)):
                    keys, counts = made()
                    distinct, n = _counted(keys, np.repeat(~held, counts))
                    order, buckets = _by_bucket(kind, distinct, bits)
                    distinct, n = distinct[order], n[order]
                    edges = np.append(np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])), len(buckets)) if len(buckets) else [0]
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        out.append((kind, int(buckets[a]), _pack_sorted(distinct[a:b]), _pack(n[a:b])))
                about = np.concatenate([
                    row + (part << 36), [0 if x is None else x for x in own], [x is None for x in own], held, last, sizes]).astype(np.int64)
                out.append((TEXT, 0, zstandard.ZstdCompressor(level=1).compress(data.tobytes()), about.tobytes() + before.tobytes()))
                columns = list(zip(*out, strict=True))
                yield pa.record_batch([
                    pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(np.full(len(out), (part << 24) + number)),
                    pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary()),
                ], ["kind", "bucket", "block", "a", "b"])
                number += 1
            first_row += len(batch)

    return rows


# --- buckets


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Iterator[dict]]]:
    """Rows of each (kind, bucket) of a sorted stream."""
    def rows():
        for batch in batches:
            for i in range(len(batch)):
                yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}

    yield from itertools.groupby(rows(), key=lambda x: (x["kind"], x["bucket"]))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grams and words of each bucket with their counts, in slices; contexts of the same two bytes share a slice."""
    def added(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        return distinct, np.bincount(place, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)

    for (kind, bucket), rows in _groups(batches):
        keys, counts, size = [], [], 0
        for row in rows:
            keys.append(_unpack_sorted(row["a"]))
            counts.append(_unpack(row["b"]).astype(np.int64))
            size += len(keys[-1])
            if size > 1 << 21 and size > 2 * len(keys[0]):
                distinct, n = added(keys, counts)
                keys, counts, size = [distinct], [n], len(distinct)
        keys, counts = added(keys, counts)
        at = 0
        while at < len(keys):
            stop = min(at + SLICE, len(keys))
            if kind == GRAMS and stop < len(keys):
                shift = np.uint64(8 * (DEPTH - 1))
                begin = int(np.searchsorted(keys >> shift, keys[stop] >> shift))
                stop = begin if begin > at else int(np.searchsorted(keys >> shift, keys[stop] >> shift, "right"))
            n = counts[at:stop]
            yield pa.record_batch([
                pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([at], pa.int64()), pa.array([_pack_sorted(keys[at:stop])], pa.binary()),
                pa.array([_pack(n)], pa.binary()), pa.array([int(n.sum())], pa.int64()), pa.array([int((n > 0).sum())], pa.int64()),
            ], ["kind", "bucket", "block", "a", "b", "total", "seen"])
            at = stop


class Level:
    """Nodes of one depth for the decision on one bit of a byte, from those one deeper."""

    def __init__(self, names: np.ndarray, ones: np.ndarray, both: np.ndarray, children: np.ndarray | None, place: np.ndarray | None) -> None:
        self.names, self.ones, self.both, self.place = names, ones, both, place  # place: of the deeper level's nodes in this one
        estimate = log_kt(both - ones, ones)
        self.weighted = estimate if children is None else np.logaddexp(estimate, children) - np.log(2)
        self.share = np.exp(estimate - self.weighted) if children is None else np.exp(estimate - self.weighted - np.log(2))
        self.guess = (ones + 0.5) / (both + 1.0)  # that the bit is 1

    def above(self) -> Level:
        names, place = np.unique((self.names >> np.uint64(16)) << np.uint64(8) | (self.names & np.uint64(255)), return_inverse=True)
        ones, both, children = (np.bincount(place, weights=x, minlength=len(names)) for x in (self.ones, self.both, self.weighted))
        return Level(names, ones, both, children, place)


def levels(keys: np.ndarray, counts: np.ndarray, bit: int) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """Levels from ``DEPTH`` up to 2 of a slice, the deepest node of each gram and whether its bit is 1.

    A node is named by its context and by the bits before, behind a leading 1.
    """
    byte = keys & np.uint64(255)
    name = (keys >> np.uint64(8)) << np.uint64(8) | (byte | np.uint64(256)) >> np.uint64(8 - bit)
    one = (byte >> np.uint64(7 - bit)) & np.uint64(1) == 1
    new = np.append(True, name[1:] != name[:-1])
    place = np.cumsum(new) - 1
    found = [Level(name[new], np.bincount(place, weights=counts * one), np.bincount(place, weights=counts), None, None)]
    while len(found) < DEPTH - 1:
        found.append(found[-1].above())
    return found, place, one


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ones, both, weighted) summed per slice for the contexts of one byte."""
    for batch in batches:
        for a, b in zip(batch.column(0), batch.column(1), strict=True):
            keys, counts = _unpack_sorted(a.as_py()), _unpack(b.as_py()).astype(float)
            out = []
            for bit in range(8):
                two = levels(keys, counts, bit)[0][-1]
                fixed = np.rint(two.weighted * FRACTION)
                names, place = np.unique((two.names >> np.uint64(16)) << np.uint64(8) | (two.names & np.uint64(255)), return_inverse=True)
                out.append([names, *(np.bincount(place, weights=x, minlength=len(names)) for x in (two.ones, two.both, fixed))])
            yield pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["node", "ones", "both", "weighted"])


def top_levels(sums: pa.Table) -> tuple[np.ndarray, ...]:
    """Shares and guesses of the contexts of one byte and of none, by node name."""
    names = sums.column("node").to_numpy()
    columns = [sums.column(x).to_numpy().astype(float) for x in ("ones", "both", "weighted")]
    one = Level(names.astype(np.uint64), columns[0], columns[1], columns[2] / FRACTION, None)
    none = one.above()
    shares, guesses = np.full(1 << 16, 0.5), np.full(1 << 16, 0.5)
    shares[names], guesses[names] = one.share, one.guess
    root_share, root_guess = np.full(256, 0.5), np.full(256, 0.5)
    at = none.names.astype(np.int64)
    root_share[at], root_guess[at] = none.share, none.guess
    return shares, guesses, root_share, root_guess


def gram_logs(keys: np.ndarray, counts: np.ndarray, top: tuple[np.ndarray, ...]) -> np.ndarray:
    """log10 of the probability of each gram's byte in its context."""
    shares, guesses, root_share, root_guess = top
    logs = np.zeros(len(keys))
    for bit in range(8):
        found, place, one = levels(keys, counts, bit)
        guess, way = found[0].guess, np.arange(len(found[0].names))
        for level in found[1:]:
            way = level.place[way]
            guess = level.share[way] * level.guess[way] + (1 - level.share[way]) * guess
        names = found[0].names
        near = ((names >> np.uint64(8 * DEPTH)) << np.uint64(8) | (names & np.uint64(255))).astype(np.int64)
        guess = shares[near] * guesses[near] + (1 - shares[near]) * guess
        root = near & 255
        guess = root_share[root] * root_guess[root] + (1 - root_share[root]) * guess
        logs += np.log10(np.where(one, guess[place], 1 - guess[place]))
    return logs


ANSWERS = "block bigint, kind int, bucket int, a binary"


def _answers(top):
    """For every request the values of its keys in its own order, from a stream with each bucket's slices before its requests."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, bucket), group in _groups(batches):
            keys, values = [], []
            known = None
            for row in group:
                if row["asked"] == 0:
                    keys.append(_unpack_sorted(row["a"]))
                    counts = _unpack(row["b"])
                    values.append(gram_logs(keys[-1], counts.astype(float), top.value) if kind == GRAMS else counts)
                    continue
                if known is None:
                    known = np.concatenate(keys), np.concatenate(values)
                found = known[1][np.searchsorted(known[0], _unpack_sorted(row["a"]))]
                blob = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(found.astype(np.float32).view(np.uint8).reshape(-1, 4).T).tobytes()) if kind == GRAMS else _pack(found)
                yield pa.record_batch([pa.array([row["block"]]), pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())],
                                      ["block", "kind", "bucket", "a"])

    return rows


def _floats(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1).T).view(np.float32).ravel()


SCORES = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double"


def _scores(bits: int, texts_learned: int):
    """Scores of the pieces of a stream with each block's answers before its texts."""
    def summed(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        sums = np.append(0.0, np.cumsum(values, dtype=np.float64))
        ends = np.cumsum(counts)
        return sums[ends] - sums[ends - counts]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: dict[int, list[np.ndarray]] = {GRAMS: [], WORDS: []}
        for batch in batches:
            for i in range(len(batch)):
                kind = batch.column(1)[i].as_py()
                blob = batch.column(3)[i].as_py()
                if kind != TEXT:
                    answers[kind].append(_floats(blob) if kind == GRAMS else _unpack(blob))
                    continue
                about = batch.column(4)[i].as_py()
                n = len(about) // (48 + DEPTH)
                row, ids, null, held, last, sizes = np.frombuffer(about, np.int64, 6 * n).reshape(6, n)
                before = np.frombuffer(about, np.uint8, offset=48 * n).reshape(n, DEPTH)
                data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
                texts = Block(data, sizes, last.astype(bool), before, held.astype(bool))
                found = {}
                for kind, made in ((GRAMS, texts.grams), (WORDS, texts.words)):
                    keys, counts = made()
                    distinct = np.unique(keys)
                    values = np.zeros(len(distinct), np.float64 if kind == GRAMS else np.int64)
                    if len(distinct):
                        values[_by_bucket(kind, distinct, bits)[0]] = np.concatenate(answers[kind])
                        found[kind] = values[Places(distinct).of(keys)], counts
                    else:
                        found[kind] = values, counts
                answers = {GRAMS: [], WORDS: []}
                times, words = found[WORDS]
                tokens = words + last
                known = summed(times > 0, words).astype(np.int64) + last * (texts_learned > 0)
                base = summed(np.log10(times + 1.0), words) + last * np.log10(texts_learned + 1.0)
                yield pa.record_batch([
                    pa.array(row), pa.array(ids, mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(tokens), pa.array(known), pa.array(base),
                    pa.array(summed(*found[GRAMS])),
                ], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    return rows


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, block: int = BLOCK) -> DataFrame:
    """One row per document: id, whether it was held out, tokens, known tokens, training tokens, base score and the model's score.

    ``score`` is the log10 probability of the lower-cased text and its end;
    ``bits_per_byte`` its code length over the coded bytes, the end included. A
    null text is empty, a null id is written as nothing when the fold is drawn.
    Repeated rows are learned from and scored each. Without training texts the
    model is uniform over bits. Other columns are not looked at.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds
    size, learned = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0)), F.coalesce(F.sum((fold != held_out).cast("bigint")), F.lit(0))).first()
    bits = min(16, max(4, (size // BUCKET).bit_length()))
    asked = written(docs.mapInArrow(_requests(block, bits, folds, held_out), REQUESTS), "requests", "kind").select(
        F.col("kind").cast("int").alias("kind"), "bucket", "block", "a", "b")
    keys = asked.where(f"kind <> {TEXT}")
    model = written(
        keys.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(_sums, REQUESTS + ", total bigint, seen bigint"), "model")
    tokens, words = model.where(f"kind = {WORDS}").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("seen"), F.lit(0))).first()
    tokens, words = tokens + learned, words + (learned > 0)
    # 65,536 rows at most
    tops = model.where(f"kind = {GRAMS}").select("a", "b").mapInArrow(_tops, "node bigint, ones bigint, both bigint, weighted bigint")
    top = spark.sparkContext.broadcast(top_levels(tops.groupBy("node").agg(*[F.sum(x).alias(x) for x in ("ones", "both", "weighted")]).toArrow()))
    both = model.select("kind", "bucket", "block", "a", "b", F.lit(0).alias("asked")).unionByName(keys.withColumn("asked", F.lit(1)))
    answers = both.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "asked", "block").mapInArrow(_answers(top), ANSWERS)
    texts = asked.where(f"kind = {TEXT}").select("block", "kind", "bucket", "a", "b")
    parts = (
        answers.withColumn("b", F.lit(None).cast("binary")).unionByName(texts)
        .repartition("block").sortWithinPartitions("block", "kind", "bucket").mapInArrow(_scores(bits, learned), SCORES)
    )
    each = parts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "score")])
    return each.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(tokens + words + 1)))).alias("base_score"), "score")
