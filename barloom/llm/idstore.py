"""Token ids as compressed documents with a shared dictionary.

A store is a folder with two Parquet tables. ``dictionary`` holds one
zstandard dictionary, trained on the serialized ids of a bounded sample of
documents. ``shards`` holds containers in ascending order of document ids. A
container begins with a mark, the width of an id, the hash of its dictionary
and the number of documents; then come document ids, their numbers of ids and
the offsets of their frames; then the frames, each a document compressed by
itself, so that one short document can be read without its neighbours.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barloom.llm.encode import encoded, tokenizer

MARK = b"IDS1"
HEAD = struct.Struct("<4sB32sI")
#: documents that the dictionary is trained on at most, its bytes, and bytes and documents of one container
SAMPLE, DICTIONARY, SHARD, DOCUMENTS = 2000, 1 << 16, 4 << 20, 20_000
LEVEL = 3
#: bytes of a sampled document's ids that the dictionary is trained on
CLIP = 1 << 14

SHARDS = "part int, seq int, before bigint, n_docs int, n_ids bigint, dictionary string, content binary"


def width(path: str) -> int:
    return 2 if tokenizer(path).get_vocab_size() <= 1 << 16 else 4


def trained(docs: DataFrame, path: str, end: int, sample: int = SAMPLE, size: int = DICTIONARY) -> bytes:
    """A dictionary from some ``sample`` documents whose ids fall under a hash threshold; empty where there is too little to train on.

    The threshold alone chooses, so every part of the table is met alike and
    reruns agree. Of a long document the first ``CLIP`` bytes of ids are learned
    from, which bounds what the one training task holds; all are compressed.
    """
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, samples = f"<u{width(path)}", []
        for batch in batches:
            for _, ids, begins in encoded(batch.column(0), path):
                samples += [np.append(ids[begins[i] : begins[i + 1]], end).astype(kind).tobytes()[:CLIP] for i in range(len(begins) - 1)]
        try:
            found = zstandard.train_dictionary(size, samples).as_bytes() if samples else b""
        except zstandard.ZstdError:
            found = b""
        yield pa.record_batch([pa.array([found], pa.binary())], ["dictionary"])

    parts = 1 << 30
    share = min(parts, -(-sample * parts // max(1, docs.count())))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(parts)) < share)
    rows = chosen.select("text").repartition(1).mapInArrow(train, "dictionary binary").collect()  # one value of at most DICTIONARY bytes
    return bytes(rows[0][0]) if rows else b""


def container(names: list, frames: list[bytes], counts: list[int], each: int, digest: bytes) -> bytes:
    valid = np.array([x is not None for x in names], np.uint8)
    ids = np.array([x or 0 for x in names], "<i8")
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in frames])]).astype("<u8")
    head = HEAD.pack(MARK, each, digest, len(names))
    return b"".join([head, valid.tobytes(), ids.tobytes(), np.array(counts, "<u4").tobytes(), offsets.tobytes(), *frames])


class Container:
    """A container's index; ``ids(k)`` decompresses its k-th document only."""

    def __init__(self, content: bytes, dictionary: bytes) -> None:
        mark, self.each, digest, n = HEAD.unpack_from(content)
        if mark != MARK or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a container of this dictionary")
        at = HEAD.size
        valid = np.frombuffer(content, np.uint8, n, at)
        names = np.frombuffer(content, "<i8", n, at + n)
        self.names = [x if ok else None for x, ok in zip(names.tolist(), valid.tolist(), strict=True)]
        self.counts = np.frombuffer(content, "<u4", n, at + 9 * n)
        self.offsets = np.frombuffer(content, "<u8", n + 1, at + 13 * n)
        self.content, self.base = content, at + 13 * n + 8 * (n + 1)
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, k: int) -> np.ndarray:
        frame = self.content[self.base + int(self.offsets[k]) : self.base + int(self.offsets[k + 1])]
        return np.frombuffer(self.reader.decompress(frame), f"<u{self.each}").astype("<u4")


def write(docs: DataFrame, folder: str, path: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, a null one as empty, append the end id and store the documents by ascending id, null ids first.

    Documents of one id stand side by side, in the order of a hash of their texts.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dictionary = trained(docs, path, end)
    name = hashlib.sha256(dictionary).hexdigest()
    spark = docs.sparkSession
    spark.createDataFrame([(name, bytearray(dictionary))], "hash string, dictionary binary").write.parquet(f"{folder}/dictionary")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before, each = TaskContext.get().partitionId(), 0, 0, width(path)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        digest = bytes.fromhex(name)
        names, frames, counts, size = [], [], [], 0

        def made() -> pa.RecordBatch:
            values = (part, seq, before, len(names), sum(counts), name, container(names, frames, counts, each, digest))
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.binary())
            return pa.record_batch([pa.array([v], t) for v, t in zip(values, types, strict=True)], [x.split()[0] for x in SHARDS.split(", ")])

        for batch in batches:
            own = batch.column(0).to_pylist()
            for first, ids, begins in encoded(batch.column(1), path):
                for i in range(len(begins) - 1):
                    found = np.append(ids[begins[i] : begins[i + 1]], end).astype(f"<u{each}")
                    names.append(own[first + i])
                    frames.append(packer.compress(found.tobytes()))
                    counts.append(len(found))
                    size += len(frames[-1])
                    if size >= SHARD or len(names) >= DOCUMENTS:
                        yield made()
                        seq, before = seq + 1, before + sum(counts)
                        names, frames, counts, size = [], [], [], 0
        if names:
            yield made()

    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(shards, SHARDS).write.parquet(f"{folder}/shards")


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document, and its ids if asked for; start counts the ids of all documents before it."""
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first()["dictionary"])
    stored = spark.read.schema(SHARDS).parquet(f"{folder}/shards")
    total = F.sum("n_ids")
    parts = stored.groupBy("part").agg(total.alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("earlier"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, start in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                held = Container(content.as_py(), dictionary)
                ids = [held.ids(k) for k in range(len(held.names))]
                counts = held.counts.astype(np.int64)
                columns = [
                    pa.array(held.names, pa.int64()), pa.array(start + np.cumsum(counts) - counts), pa.array(counts),
                    pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                yield pa.record_batch(columns, names)

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    # one row of 16 bytes per writing task
    return stored.join(F.broadcast(parts), "part").select("content", (F.col("before") + F.col("earlier")).alias("start")).mapInArrow(documents, schema)
