"""Near duplicates by the Jaccard similarity of word n-grams, from token-combination prefixes.

A document is the set of its distinct n-word shingles. All sets are ordered
alike: rare shingles by hash, then frequent ones by count and hash. Two sets
that link miss few of each other's shingles, so the beginnings of both must
meet. A rare shingle is indexed alone. Frequent shingles fall into classes, and
pairs of one class are indexed, for which the beginning is extended by the
shingles that the classes can hide. It ends once what it guarantees exceeds the
shingles that may be missing by ``EVIDENCE``: two sets that link then share
``EVIDENCE`` rare shingles or one pair of frequent ones. Every candidate is
verified on the whole sets.

Rare shingles have short lists by definition. A long list is searched by
pivots, first the member with the fewest rare shingles, which is the most
central one: each round every member is compared with one member of the list
and lists whose members are all connected drop out; what is left after a few
rounds is compared in full across components. Two members that share no rare
shingle cannot share more than their frequent ones, which rules most pairs of a
loose group out; pairs that share a few rare ones are known from the short lists
and judged there with that number added. Parity bitmaps of the sets bound what
two members share from above before the sets themselves are fetched. So a large group of near copies costs
its size and not its square, and no link that would join two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StructField, StructType

from barloom.llm.shared import written
from barloom.llm.words import MULTIPLIER, Spans, chunks, mixed

WORDS, PERCENT = 4, 85
#: longest list of a rare shingle; entries of the table of frequent ones (16 bytes each); shared rare shingles asked for
RARE, FREQUENT, EVIDENCE = 32, 1 << 20, 4
ROUNDS = 2
#: parts of a list that a pivot meets apart, and members of a block of the last comparison
SALTS, MEMBERS = 16, 8192
#: 64-bit words of a set's parity bitmap
BITMAP = 8
#: shingles counted at once by a task, and their bits that are counted
FLUSH, BITS = 1 << 20, 40
NO_FREQUENT = (np.zeros(0, np.int64), np.zeros(0, np.int64))

PROFILE = StructType([StructField(x, LongType()) for x in ("n_shingles", "k1", "k2")])


def sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles by row and hash, and where each row begins; a shorter text is one shingle."""
    spans = Spans(data, offsets, lower=True)
    at, keys = spans.windows(n)
    rows = spans.row_of_word[at]
    for k in range(1, n):
        if (spans.counts == k).any():
            first, short = spans.windows(k)
            own = spans.counts[spans.row_of_word[first]] == k
            rows = np.concatenate([rows, spans.row_of_word[first[own]]])
            keys = np.concatenate([keys, mixed(short[own] + np.uint64(k))])
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    if len(keys):
        new = np.append(True, (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1]))
        rows, keys = rows[new], keys[new]
    return rows, keys, np.searchsorted(rows, np.arange(spans.rows + 1))


def set_keys(keys: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every row's set."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.zeros(len(keys) + 1, np.uint64)
        np.cumsum(mixed(keys * np.uint64(salt)), out=sums[1:])
        out.append(mixed(np.diff(sums[begins]) + np.diff(begins).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def profile(n: int):
    """Size and two hashes of each text's set."""
    @arrow_udf(PROFILE)
    def of(texts: pa.Array) -> pa.Array:
        found = [[], [], []]
        for _, data, offsets in chunks(texts):
            _, keys, begins = sets(data, offsets, n)
            for column, values in zip(found, (np.diff(begins), *set_keys(keys, begins)), strict=True):
                column.append(values)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in found], PROFILE.names)

    return of


# --- which shingles are frequent


def _packed(values: np.ndarray) -> bytes:
    """Sorted values as compressed planes of the bytes of their differences."""
    gaps = np.diff(values, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.T).tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel()).astype(np.int64)


def _count_blobs(n: int, buckets: int):
    """The shingles of a task as sorted blobs per bucket of their hashes, each once per hand-over with its count."""
    low = BITS - (buckets.bit_length() - 1)

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            values, counts = np.unique((np.concatenate(held) >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
            edges = np.searchsorted(values, np.arange(buckets + 1, dtype=np.int64) << low)
            full = np.flatnonzero(np.diff(edges))
            own = [slice(edges[b], edges[b + 1]) for b in full.tolist()]
            return pa.record_batch([
                pa.array(full.astype(np.int32)), pa.array([_packed(values[x]) for x in own], pa.binary()),
                pa.array([zstandard.ZstdCompressor(level=1).compress(counts[x].astype("<u4").tobytes()) for x in own], pa.binary()),
            ], ["bucket", "blob", "counts"])

        held, size = [], 0
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                held.append(sets(data, offsets, n)[1])
                size += len(held[-1])
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return blobs


def _frequent(rare: int):
    """Shingles of a sorted stream of buckets that are counted more often than ``rare`` times; a task holds the distinct ones of a bucket."""
    def merged(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        distinct, place = np.unique(np.concatenate(values), return_inverse=True)
        return distinct, np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, values, counts, size = None, [], [], 0

        def out() -> pa.RecordBatch:
            distinct, n = merged(values, counts)
            return pa.record_batch([pa.array(distinct[n > rare]), pa.array(n[n > rare])], ["shingle", "n"])

        for batch in batches:
            for b, blob, times in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if b != bucket and values:
                    yield out()
                    values, counts, size = [], [], 0
                bucket = b
                values.append(_unpacked(blob.as_py()))
                counts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(times.as_py()), "<u4"))
                size += len(values[-1])
                if size > FLUSH and size > 2 * len(values[0]):
                    distinct, n = merged(values, counts)
                    values, counts, size = [distinct], [n], len(distinct)
        if values:
            yield out()

    return over


def frequent_shingles(docs: DataFrame, total: int, n: int, rare: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles and their counts, at most ``most``: where more are counted, the count that makes one frequent doubles until they fit."""
    buckets = 1 << max(6, (total >> 21).bit_length())
    counted = written(
        docs.select("text").mapInArrow(_count_blobs(n, buckets), "bucket int, blob binary, counts binary")
        .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_frequent(rare), "shingle bigint, n bigint"),
        "frequent",
    )
    by_size = counted.groupBy(F.floor(F.log2("n")).alias("size")).count().orderBy(F.desc("size")).collect()  # 64 rows at most
    least, room = rare + 1, most
    for row in by_size:
        room -= row["count"]
        if room < 0:
            least = max(least, 1 << (row["size"] + 1))
            break
    found = counted.where(F.col("n") >= least).toArrow()
    shingles, counts = found.column("shingle").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(shingles)
    return shingles[order], counts[order]


# --- signatures


def _levels(size: int, percent: int) -> range:
    """Size classes of the sets that one of this size can link with."""
    return range((-(-percent * size // 100)).bit_length(), (100 * size // percent).bit_length() + 1)


def _beginning(rare: np.ndarray, frequent: np.ndarray, need: int, classes: int) -> Iterator[tuple[int, list[int]]]:
    """Frequent shingles of the beginning by class; a class guarantees all its shingles but one."""
    held: dict[int, list[int]] = {}
    gained = len(rare)
    for shingle in frequent.tolist():
        if gained >= need:
            break
        own = held.setdefault(shingle % classes, [])
        gained += bool(own)
        own.append(shingle)
    return iter(held.items())


def _signatures(n: int, percent: int, table):
    """Rows (paired, sig, k1, size, common) of every distinct set of a task; ``common`` counts the frequent shingles of a set that has pairs."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = table.value
        seen: set[int] = set()
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                row, keys, begins = sets(data, offsets, n)
                k1 = set_keys(keys, begins)[0]
                size = np.diff(begins)
                need = size - (percent * size + 99) // 100 + EVIDENCE
                least = (percent * size + 99) // 100  # shingles that a link needs at least
                # a set of which the nearest other one, a shingle more or less, is too far links with equal ones only
                live = (100 * size >= percent * (size + 1)) | ((size > 1) & (100 * (size - 1) >= percent * size))
                for i, key in enumerate(k1.tolist()):
                    if live[i]:
                        live[i] = key not in seen
                        seen.add(key)
                short = (keys >> np.uint64(64 - BITS)).astype(np.int64)
                place = np.minimum(np.searchsorted(shingles, short), max(len(shingles) - 1, 0))
                often = shingles[place] == short if len(shingles) else np.zeros(len(keys), bool)
                before = np.append(0, np.cumsum(~often))
                rank = before[:-1] - before[begins[row]]
                taken = ~often & live[row] & (rank < need[row])
                paired = [np.zeros(int(taken.sum()), bool)]
                sig, whose = [keys[taken]], [row[taken]]
                few = np.flatnonzero(live & (np.diff(before[begins]) < need))
                for i in few.tolist():
                    own = slice(begins[i], begins[i + 1])
                    common = np.flatnonzero(often[own]) + begins[i]
                    common = keys[common[np.lexsort((keys[common], counts[place[common]]))]]
                    rare = keys[own][~often[own]]
                    for level in _levels(int(size[i]), percent):
                        classes = max(1, (1 << (level - 1)) // 8)
                        first, second = [], []
                        for _, held in _beginning(rare, common, int(need[i]), classes):
                            held.sort()
                            for k in range(1, len(held)):
                                first += held[:-k]
                                second += held[k:]
                        if not first:  # known as one whose rare shingles may be too few to tell
                            first, second = [int(k1[i].view(np.uint64))], [level]
                        pair = mixed(mixed(np.array(first, np.uint64) + np.uint64(level)) * np.uint64(MULTIPLIER) + np.array(second, np.uint64))
                        sig.append(pair)
                        whose.append(np.full(len(pair), i))
                        paired.append(np.ones(len(pair), bool))
                    if least[i] <= 1:  # one shared shingle may be a link
                        sig.append(common)
                        whose.append(np.full(len(common), i))
                        paired.append(np.ones(len(common), bool))
                who, pairs = np.concatenate(whose), np.concatenate(paired)
                common = np.where(pairs, size[who] - np.diff(before[begins])[who], size[who])
                columns = [pa.array(pairs), pa.array(np.concatenate(sig).view(np.int64)), pa.array(k1[who])]
                columns += [pa.array(x.astype(np.int32)) for x in (size[who], common)]
                out = pa.record_batch(columns, ["paired", "sig", "k1", "size", "common"])
                for at in range(0, len(out), 1 << 16):
                    yield out.slice(at, 1 << 16)

    return rows


def _list_pairs(percent: int, longest: int):
    """Pairs of each short list of a stream sorted by signature; the members of a longer one as they are."""
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(sig, key, size, long: bool) -> pa.RecordBatch:
            if long:
                columns = [pa.array(sig), pa.array(key), pa.nulls(len(sig), pa.int64()), pa.array(size)]
            else:
                a, b = [], []
                for step in range(1, longest):
                    same = sig[step:] == sig[:-step]
                    if not same.any():
                        break
                    x, y = size[step:], size[:-step]
                    at = np.flatnonzero(same & (key[step:] != key[:-step]) & (100 * np.minimum(x, y).astype(np.int64) >= percent * np.maximum(x, y).astype(np.int64)))
                    a.append(np.minimum(key[at], key[at + step]))
                    b.append(np.maximum(key[at], key[at + step]))
                a = np.concatenate(a) if a else np.zeros(0, np.int64)
                columns = [pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(np.concatenate(b) if b else a), pa.nulls(len(a), pa.int32())]
            return pa.record_batch(columns, ["sig", "a", "b", "size"])

        def split(sig, key, size):
            edges = np.append(np.flatnonzero(np.append(True, sig[1:] != sig[:-1])), len(sig))
            long = np.repeat(np.diff(edges) > longest, np.diff(edges))
            yield made(sig[~long], key[~long], size[~long], False)
            if long.any():
                yield made(sig[long], key[long], size[long], True)

        held = None
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(3)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            sig = now[0]
            if not len(sig):
                continue
            last = int(np.searchsorted(sig, sig[-1]))
            if last > 0:
                yield from split(*[x[:last] for x in now])
            if len(sig) - last > longest:  # a long list goes on; what is held stays small
                keep = len(sig) - longest - 1
                yield made(*[x[last:keep] for x in now], True)
                last = keep
            held = [x[last:] for x in now]
        if held is not None:
            yield from split(*held)

    return pairs


# --- verification and components


def _members(n: int):
    """The set of each asked-for document; a row whose text is not the one asked for is left out."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch.column(0)):
                _, keys, begins = sets(data, offsets, n)
                k1, k2 = set_keys(keys, begins)
                part = batch.slice(row, len(offsets) - 1)
                same = (part.column(2).to_numpy() == k1) & (part.column(3).to_numpy() == k2)
                at = np.flatnonzero(same)
                size = np.diff(begins)
                own = keys[np.repeat(same, size)].view(np.int64)
                edges = np.append(0, np.cumsum(size[at]))
                yield pa.record_batch([part.column(1).take(pa.array(at)), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(own))], ["node", "members"])

    return rows


@arrow_udf(StructType([StructField(f"b{k}", LongType()) for k in range(BITMAP)]))
def bitmap(members: pa.Array) -> pa.Array:
    """Parity of the number of shingles at each of 64 * BITMAP places; each place where two sets differ is a shingle that they do not share."""
    sizes = np.diff(members.offsets.to_numpy())
    places = members.flatten().to_numpy().view(np.uint64) % np.uint64(64 * BITMAP)
    out = np.bincount(np.repeat(np.arange(len(sizes)) * 64 * BITMAP, sizes) + places.astype(np.int64), minlength=len(sizes) * 64 * BITMAP) & 1
    words = np.packbits(out.astype(bool).reshape(-1, 64 * BITMAP), axis=1).view(np.int64)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(words[:, k])) for k in range(BITMAP)], [f"b{k}" for k in range(BITMAP)])


def verified(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, exactly."""
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(members.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
        .join(members.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
        .select("a", "b", (F.size("x") + F.size("y")).alias("sizes"), both.alias("both"))
        .where(100 * F.col("both") >= percent * (F.col("sizes") - F.col("both"))).select("a", "b")
    )


def _stars(edges: DataFrame) -> bool:
    """Whether every node either is a centre or has one centre, so that each component is one star."""
    ends = edges.select("u", F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
    roles = ends.groupBy("u").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return roles.where("leaf + centre > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node, by alternating large and small stars until stars are left."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = written(edges, "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _labelled(lists: DataFrame, found: DataFrame) -> DataFrame:
    """Members of the lists that hold more than one component."""
    own = lists.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    many = own.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("sig")
    return own.join(many, "sig", "left_semi")


def _fitting(percent: int):
    """Whether two members can be similar: by the frequent shingles that they can share at most, and by their bitmaps."""
    apart = " + ".join(f"bit_count(b{k} ^ w{k})" for k in range(BITMAP))
    bounds = ("least(common, other_common)", f"shiftright(size + other - ({apart}), 1)")
    return F.expr(" and ".join(f"100 * {most} >= {percent} * (size + other - {most})" for most in bounds))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT,
            rare: int = RARE, most_frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Texts without words (null, empty, white space) have no shingles and their
    own id as component. Equal sets are one node whatever their number. A row
    with a null id links nothing and has a null component. Rows of one id are
    nodes by their texts. Other columns are not looked at.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(docs.select("doc_id", profile(n)("text").alias("p")).select("doc_id", "p.*"), "profiles")
    real = rows.where("n_shingles > 0 and doc_id is not null")
    nodes = written(real.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.first("n_shingles").cast("int").alias("size")), "nodes")
    total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    named = docs.where("doc_id is not null and text is not null")
    table = spark.sparkContext.broadcast(frequent_shingles(named, total, n, rare, most_frequent))
    signatures = written(
        named.select("text").mapInArrow(_signatures(n, percent, table), "paired boolean, sig bigint, k1 bigint, size int, common int"), "signatures", "paired",
    )
    short = written(
        signatures.where(~F.col("paired")).select("sig", "k1", "size").repartition("sig").sortWithinPartitions("sig", "k1")
        .mapInArrow(_list_pairs(percent, rare), "sig bigint, a bigint, b bigint, size int")
        # a pair once with its count, a long list's member as it is
        .groupBy("sig", "a", "b", "size").agg(F.count("*").alias("n")),
        "pairs",
    )
    by_key = nodes.select("k1", "node")
    few = signatures.where("paired").select("k1", "size", "common").distinct()
    most = "(least(x.common, y.common) + n)"
    # without a pair of frequent shingles too few rare ones rule a link out, so only sets that have pairs are asked
    weak = (
        short.where(f"sig is null and n < {EVIDENCE}").select("a", "b", "n")
        .join(few.alias("x"), F.expr("a = x.k1")).join(few.alias("y"), F.expr("b = y.k1"))
        .where(f"100 * {most} >= {percent} * (x.size + y.size - {most})").select("a", "b")
    )
    pairs = (
        short.where(f"sig is null and n >= {EVIDENCE}").select("a", "b").unionByName(weak)
        .join(by_key.select(F.col("k1").alias("a"), F.col("node").alias("na")), "a")
        .join(by_key.select(F.col("k1").alias("b"), F.col("node").alias("nb")), "b")
        .select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).where("a <> b").distinct()
    )
    pairs = written(pairs, "candidates")
    long = (
        signatures.where(F.col("paired") & (F.expr(f"100 * common >= {percent} * size"))).select("sig", "k1", "size", "common")
        # what is counted of the rare shingles of a long list is not known
        .unionByName(short.where("sig is not null").select("sig", F.col("a").alias("k1"), "size", F.col("size").alias("common")))
    )
    shared = long.groupBy("sig").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low < high").select("sig")
    lists = written(
        long.join(shared, "sig", "left_semi").join(by_key, "k1").select("sig", "node", "size", "common").distinct(), "lists",
    )
    asked = pairs.select("a").union(pairs.select("b")).union(lists.select("node")).toDF("node").distinct()
    asked = asked.join(nodes.select("node", "k1", "k2"), "node")
    sets_of = written(
        named.join(asked.withColumnRenamed("node", "doc_id"), "doc_id").select("text", "doc_id", "k1", "k2")
        .mapInArrow(_members(n), "node bigint, members array<bigint>").groupBy("node").agg(F.first("members").alias("members")),
        "sets",
    )
    links = written(verified(pairs, sets_of, percent), "links")
    found = components(links)
    tried = pairs
    lists = written(lists.join(sets_of.select("node", bitmap("members").alias("b")), "node").select(*lists.columns, "b.*"), "lists")
    mate = [F.col(a).alias(b) for a, b in (("node", "with"), ("component", "theirs"), ("size", "other"), ("common", "other_common"))]
    mate += [F.col(f"b{k}").alias(f"w{k}") for k in range(BITMAP)]
    for turn in range(ROUNDS + 1):
        open_lists = written(_labelled(lists, found), "open")
        if open_lists.isEmpty():
            break
        if turn < ROUNDS:
            turned = F.struct(F.col("size") - F.col("common"), "node") if turn == 0 else F.xxhash64("node", F.lit(turn))
            member, salts = F.struct(*mate), F.array(*map(F.lit, range(SALTS)))
            salted = open_lists.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
            # the first of each part of a list, then the first of these
            firsts = salted.groupBy("sig", "salt").agg(F.min(turned).alias("turned"), F.min_by(member, turned).alias("p"))
            pivot = firsts.groupBy("sig").agg(F.min_by("p", "turned").alias("p")).select("sig", F.explode(salts).alias("salt"), "p.*")
            new = salted.join(pivot, ["sig", "salt"]).where("component <> theirs")
        else:
            # blocks of members against blocks, so that a long list is many keys
            sizes = open_lists.groupBy("sig").agg(F.ceil(F.count("*") / MEMBERS).alias("blocks"))
            cut = open_lists.join(sizes, "sig").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("all", F.expr("sequence(0L, blocks - 1)"))
            left = cut.select("sig", *open_lists.columns[1:], F.col("own").alias("x"), F.explode("all").alias("y"))
            new = left.join(cut.select("sig", *mate, F.col("own").alias("y"), F.explode("all").alias("x")), ["sig", "x", "y"]).where("component < theirs")
        new = new.where(_fitting(percent)).select(F.least("node", "with").alias("a"), F.greatest("node", "with").alias("b")).distinct()
        new = written(new.join(tried, ["a", "b"], "left_anti"), "candidates")
        more = written(verified(new, sets_of, percent), "links")
        tried = tried.unionByName(new)
        if more.isEmpty():
            continue  # another pivot, or the full comparison
        # what is connected so far is one star per component
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    named_rows = real.join(nodes, ["k1", "k2"]).join(found, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    others = rows.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named_rows.unionByName(others)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, with all columns, of which each is the one with the smallest id of its component.

    Of equal rows with one id one stays; rows with a null id all stay.
    """
    found = classes(docs, id_col, text_col, **options)
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
    place = F.row_number().over(Window.partitionBy(F.col(id_col), F.xxhash64(F.col(text_col))).orderBy(F.col(id_col)))
    columns = [F.col(f"`{x}`") for x in docs.columns]
    rows = docs.where(F.col(id_col).isNotNull()).select(F.struct(*columns).alias("row"), F.col(id_col).alias(id_col), F.col(text_col).alias(text_col))
    kept = rows.join(first, id_col, "left_semi").withColumn("place", place).where("place = 1").select("row.*")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
