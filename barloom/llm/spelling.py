"""Spelling variants: words at one edit from each other, found through variable-length grams.

Words are counted over whole texts. The gram dictionary holds the grams that are
frequent among the words: a gram that is frequent is extended by its next
character, so what indexes a word is long where the language repeats itself and
short where it does not. A word is decomposed into one gram per position. An
edit can change only the grams whose reading covers it, so the largest number of
grams that one position can affect bounds what a word at one edit may miss:
of two such words both hold, among their ``affected + 1`` rarest grams, one gram
that the edit left alone. Only these short lists are merged, at the places
where an untouched gram may stand, and every candidate is verified.

Grams are known by their 64-bit hashes; two grams of one hash share a list, which
costs a verification and never loses a pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.shared import written
from barloom.llm.words import CONTINUATION, LOWER, MULTIPLIER, Spans, chunks, mixed

#: fixed values of the base rules: shortest word, fewest occurrences, how many times its own a word's form must occur, divisor of the deletions
LEAST_CHARS, LEAST_COUNT, TIMES, DELETES = 6, 5, 5, 199
#: shortest and longest gram, occurrences above which a gram is extended, entries of the dictionary (16 bytes each): above that the number doubles
SHORTEST, LONGEST, OFTEN, MOST_GRAMS = 2, 12, 8, 1 << 20
#: distinct words that a task holds before it hands them on, and words that are decomposed at once
HELD, BLOCK = 1 << 17, 1 << 15
#: runs of more bytes take their checksum from the library, shorter ones go through it column by column
LONG_RUN = 64

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3] = True  # U+00C0 to U+00FF are 0xC3 and a continuation byte


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


# --- words and their counts


class Runs(Spans):
    """Maximal runs of letters in place of words, lower-cased in A-Z only."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        inside = _LETTER[data]
        inside[1:] |= data[:-1] == 0xC3
        self.data, self.offsets, self.rows = LOWER[data], offsets, len(offsets) - 1
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        full = offsets[:-1] < offsets[1:]
        before[offsets[:-1][full]] = False
        after[offsets[1:][full] - 1] = False
        self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(CONTINUATION[data], out=sums[1:])
        self.chars = self.ends - self.starts - (sums[self.ends] - sums[self.starts])
        self._sums = None

    def keep(self, which: np.ndarray) -> None:
        self.starts, self.ends, self.chars = self.starts[which], self.ends[which], self.chars[which]


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges, each continued from the CRC-32 ``begun`` of what goes before it."""
    state = begun.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    size = ends - starts
    active = np.flatnonzero(size <= LONG_RUN)
    for k in range(LONG_RUN):
        active = active[size[active] > k]
        if not len(active):
            break
        own = state[active]
        state[active] = _CRC[(own ^ data[starts[active] + k]) & np.uint32(0xFF)] ^ (own >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > LONG_RUN).tolist():
        state[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(begun[i]))
    return state


def _words(least: int, deletes: int):
    """(word, n) of a task's texts, each word once per hand-over."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        size = 0

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, data, offsets in chunks(batch.column(1)):
                runs = Runs(data, offsets)
                runs.keep(runs.chars >= least)
                row = np.searchsorted(offsets, runs.starts, "right") - 1
                begun = np.array([zlib.crc32(b"%d:" % x if x is not None else b":") for x in ids[first : first + len(offsets) - 1]], np.uint32)
                crc = checksums(runs.data, runs.starts, runs.ends, begun[row])
                hit = crc % deletes == 0
                for i in np.flatnonzero(hit).tolist():
                    run = runs.data[runs.starts[i] : runs.ends[i]].tobytes().decode()
                    at = int(crc[i]) % len(run)
                    if len(run) > least:
                        word = (run[:at] + run[at + 1 :]).encode()
                        size += 0 if word in held else len(word)
                        held[word] = held.get(word, 0) + 1
                runs.keep(~hit)
                _, at, n = np.unique(runs.hashes(runs.starts, runs.ends), return_index=True, return_counts=True)
                raw = runs.data.tobytes()
                for a, b, k in zip(runs.starts[at].tolist(), runs.ends[at].tolist(), n.tolist(), strict=True):
                    word = raw[a:b]
                    if word in held:
                        held[word] += k
                    else:
                        held[word] = k
                        size += b - a
                if len(held) >= HELD or size >= 16 * HELD:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    return counted


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS,
                least_count: int = LEAST_COUNT, deletes: int = DELETES) -> DataFrame:
    """(word, n) over all texts; a null text has no words, a null id is written as nothing before the colon."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return (
        rows.mapInArrow(_words(least_chars, deletes), "word string, n bigint")
        .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    )


# --- grams


class Block:
    """Words as one array of characters, each word followed by two places that belong to none."""

    def __init__(self, words: list[str]) -> None:
        self.data = np.frombuffer("".join(x + "\0\0" for x in words).encode("latin-1"), np.uint8)
        self.size = np.array([len(x) for x in words], np.int64)
        self.begin = np.cumsum(self.size + 2) - self.size - 2
        grams = np.maximum(self.size - SHORTEST + 1, 0)
        self.word = np.repeat(np.arange(len(words)), grams)
        self.at = np.arange(len(self.word)) - np.repeat(np.cumsum(grams) - grams, grams)
        self.place = self.begin[self.word] + self.at
        self.left = self.size[self.word] - self.at  # characters from here on

    def first(self) -> np.ndarray:
        """Hashes of the shortest grams."""
        grams = np.zeros(len(self.place), np.uint64)
        for k in range(SHORTEST):
            grams = self.longer(grams, self.place + k)
        return grams

    def longer(self, grams: np.ndarray, place: np.ndarray) -> np.ndarray:
        return mixed(grams * np.uint64(MULTIPLIER) + self.data[place] + np.uint64(1))


def longest_gram(size: np.ndarray) -> np.ndarray:
    """At most half a word of this size: an edit then leaves at least one gram alone."""
    return np.minimum(size // 2, LONGEST)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], Block]]:
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            words = batch.column(0).slice(at, BLOCK).to_pylist()
            yield words, Block(words)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n): how often the words of a task hold each gram that may index them."""
    for _, block in _blocks(batches):
        grams, found, limit = block.first(), [], longest_gram(block.size)[block.word]
        kept = np.arange(len(grams))
        for length in range(SHORTEST, int(limit.max(initial=0)) + 1):
            kept = kept[(limit[kept] >= length) & (block.left[kept] >= length)]
            if length > SHORTEST:
                grams[kept] = block.longer(grams[kept], block.place[kept] + length - 1)
            found.append(grams[kept])
        values, n = np.unique(np.concatenate(found) if found else grams, return_counts=True)
        yield pa.record_batch([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])


def gram_dictionary(words: DataFrame, often: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent grams and their counts, at most ``most``: where more are frequent, the number that makes one so doubles until they fit."""
    counted = written(
        words.select("word").mapInArrow(_gram_counts, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
        .where(F.col("n") > often), "grams",
    )
    least, room = often + 1, most
    for row in counted.groupBy(F.floor(F.log2("n")).alias("size")).count().orderBy(F.desc("size")).collect():  # 64 rows at most
        room -= row["count"]
        if room < 0:
            least = max(least, 1 << (row["size"] + 1))
            break
    found = counted.where(F.col("n") >= least).toArrow()
    grams, n = found.column("gram").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(grams)
    return grams[order], n[order]


def decomposed(block: Block, limit: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, its count or 0, characters read) at every position; ``limit`` is the longest gram of each word."""
    def counted(x: np.ndarray) -> np.ndarray:
        if not len(grams):
            return np.zeros(len(x), np.int64)
        place = np.minimum(np.searchsorted(grams, x), len(grams) - 1)
        return np.where(grams[place] == x, counts[place], 0)

    own = block.first()
    n, read = counted(own), np.full(len(own), SHORTEST)
    longest = limit[block.word]
    going = np.flatnonzero((n > 0) & (longest > SHORTEST))
    length = SHORTEST
    while len(going):
        read[going] = length + 1  # also where the end of the word is all that is met
        going = going[block.left[going] > length]
        own[going] = block.longer(own[going], block.place[going] + length)
        n[going] = counted(own[going])
        length += 1
        going = going[(n[going] > 0) & (longest[going] > length)]
    return own, n, read


def affected(block: Block, read: np.ndarray) -> np.ndarray:
    """Per word: the most grams that one edit can change, which are those that read one position."""
    change = np.bincount(block.place, minlength=len(block.data) + 1) - np.bincount(block.place + read, minlength=len(block.data) + 1)
    return np.maximum.reduceat(np.cumsum(change), block.begin) if len(block.begin) else np.zeros(0, np.int64)


def _index(table, least: int):
    """Rows (key, longer, mask, word): the lists that hold each word.

    Words of one length meet in the class of that length, words whose lengths
    differ by one in the class of the shorter one, whose grams both use. An
    untouched gram stands at the same place counted from the start or from the end.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = table.value
        for words, block in _blocks(batches):
            mask = np.bitwise_xor.reduceat(np.append(_LETTER_BIT[block.data], 0), block.begin) if len(words) else np.zeros(0, np.int64)
            keys, whose, longer = [], [], []
            for more in (0, 1):
                kind = block.size - more  # length of the shorter word of a pair
                own, n, read = decomposed(block, longest_gram(kind), grams, counts)
                # an edit keeps the order of the grams that it leaves alone, so the least of them has the same place in both words
                order = np.lexsort((block.at, own, n, block.word))
                grams_of = np.bincount(block.word, minlength=len(words))
                rank = np.arange(len(order)) - np.repeat(np.cumsum(grams_of) - grams_of, grams_of)
                word = block.word[order]
                taken = order[(rank <= affected(block, read)[word]) & (kind[word] >= least)]
                for shift in range(more + 1):
                    which = taken[block.at[taken] >= shift]
                    place = (block.at[which] - shift + 512 * kind[block.word[which]]).astype(np.uint64)
                    keys.append(mixed(own[which] + place * np.uint64(MULTIPLIER)))
                    whose.append(block.word[which])
                    longer.append(np.full(len(which), bool(more)))
            who = np.concatenate(whose)
            out = pa.record_batch([
                pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(longer)), pa.array(mask[who]),
                pa.array(words, pa.string()).take(pa.array(who)),
            ], ["key", "longer", "mask", "word"])
            for at in range(0, len(out), 1 << 16):
                yield out.slice(at, 1 << 16)

    return rows


#: a bit per character; the places between words have none
_LETTER_BIT = np.left_shift(1, np.arange(256) % 62)
_LETTER_BIT[0] = 0


# --- variants


def near_pairs(words: DataFrame, often: int = OFTEN, most: int = MOST_GRAMS) -> DataFrame:
    """(a, b), both ways and each once: the words that differ by exactly one inserted, deleted or replaced character."""
    table = words.sparkSession.sparkContext.broadcast(gram_dictionary(words, often, most))
    lists = words.select("word").mapInArrow(_index(table, LEAST_CHARS), "key bigint, longer boolean, mask bigint, word string")
    lists = written(lists, "lists")
    short = lists.where(~F.col("longer")).select("key", F.col("mask").alias("m"), F.col("word").alias("a"))
    found = (
        short.join(lists.withColumnRenamed("word", "b"), "key")
        .where("(longer or a < b) and bit_count(m ^ mask) <= 2 and levenshtein(a, b, 1) = 1").select("a", "b").distinct()
    )
    found = written(found, "near")
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))


def forms(words: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word."""
    other = pairs.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    # of the nearest the largest count, then the first in the order of code points, which is that of the bytes
    best = other.groupBy("a").agg(F.count("*").alias("n_near"), F.max("m").alias("form_n"), F.min_by("b", F.struct(-F.col("m"), F.col("b"))).alias("form"))
    joined = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    held = F.col("form_n") >= times * F.col("n")
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(held, F.col("form")).alias("form"), F.when(held, F.col("form_n")).alias("form_n"),
    )


def roots(found: DataFrame) -> DataFrame:
    """Adds ``root``: the last word that forms lead to. Counts grow by ``TIMES`` at every step, so paths are short and doubled a few times."""
    links = written(found.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if links.join(onward, "root", "left_semi").isEmpty():
            return found.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))
        links = written(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "forms")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", often: int = OFTEN, most: int = MOST_GRAMS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least six characters that occurs at least five times.

    Null and empty texts have no words; the checksum of a row without an id
    takes an empty id. Repeated rows count again. An empty table gives no rows.
    Ties of counts go to the first word in code-point order. Other columns of
    any name are not looked at.
    """
    words = written(word_counts(docs, id_col, text_col), "words")
    found = written(forms(words, near_pairs(words, often, most)), "variants")
    return roots(found).select("word", "form", "root", "n", "n_near", "form_n")
