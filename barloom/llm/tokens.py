"""Token counts of the sections of documents.

A document is encoded whole and once. Its tokens' character spans meet the
sections' in a sorted interval join, and a token that crosses a boundary goes
where the rule says: to the section of its first character (``first``), of its
last (``last``), or to the one that holds most of it (``most``, the first of
equals). Tokens in no section are counted under section -1.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.encode import PIECE, encoder, tokenizer
from barloom.llm.words import CONTINUATION, chunks

RULES = ("first", "last", "most")
COUNTS = "doc_id bigint, section int, start bigint, end bigint, n_tokens bigint, n_crossing bigint"


@lru_cache(maxsize=4)
def byte_lengths(path: str) -> np.ndarray | None:
    """Bytes of every token where tokens are the bytes of the text, else None."""
    found = tokenizer(path)
    if found.normalizer is not None or "ByteLevel" not in type(found.pre_tokenizer).__name__:
        return None
    out = np.zeros(found.get_vocab_size(), np.int64)
    for token, i in found.get_vocab().items():
        out[i] = len(token)
    return out


def token_spans(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of all tokens, in code points of their text; a token that holds part of a character spans it all."""
    before = np.append(0, np.cumsum(~CONTINUATION[data]))  # characters begun before each byte
    lengths = byte_lengths(path)
    if lengths is not None:
        ids, begins = encoder(path).chunk(data, offsets)
        ends = np.cumsum(lengths[ids])
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(begins))
        if (ends[-1] if len(ends) else 0) != len(data) or (np.append(0, ends)[begins] != offsets).any():
            raise ValueError("the tokens are not the bytes of their texts")
        first, last = before[ends - lengths[ids] + 1] - 1, before[ends] - 1
        base = before[offsets[row]]
        return row, first - base, last + 1 - base
    rows, starts, ends = [], [], []
    texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    for at in range(0, len(texts), 256):
        for k, found in enumerate(tokenizer(path).encode_batch(texts[at : at + 256], add_special_tokens=False)):
            spans = np.array(found.offsets, np.int64).reshape(-1, 2)
            rows.append(np.full(len(spans), at + k))
            starts.append(spans[:, 0])
            ends.append(spans[:, 1])
    return np.concatenate(rows), np.concatenate(starts), np.concatenate(ends)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the lines of each text in code points, a line's feed being its last character; an empty text is one empty line."""
    before = np.append(0, np.cumsum(~CONTINUATION[data]))
    breaks = np.flatnonzero(data == 0x0A) + 1
    owner = np.searchsorted(offsets, breaks, "left") - 1
    inner = breaks < offsets[owner + 1]
    starts = np.concatenate([offsets[:-1], breaks[inner]])
    row = np.concatenate([np.arange(len(offsets) - 1), owner[inner]])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    ends = np.append(starts[1:], len(data))
    base = before[offsets[row]]
    return row, before[starts] - base, before[ends] - base


def given(sections: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of sections from an array column of structs (start, end); null ones and those without a border are none, overlapping ones are refused."""
    rows, starts, ends = [], [], []
    for k, own in enumerate(sections.to_pylist()):
        before = 0
        for start, end in sorted((x["start"], x["end"]) for x in own or [] if x and x["start"] is not None and x["end"] is not None):
            if start < before or end < start:
                raise ValueError(f"sections must lie apart, but one begins at {start} and the one before it ends at {before}")
            rows.append(k)
            starts.append(start)
            ends.append(end)
            before = end
    return np.array(rows, np.int64), np.array(starts, np.int64), np.array(ends, np.int64)


def allocate(tokens, sections, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section number of each token, -1 in none, and whether it crosses a boundary of that section; sections are sorted and apart."""
    row, start, end = tokens
    srow, sstart, send = sections
    # one axis for all rows; positions of a row cannot reach the next
    wide = int(max(end.max(initial=0), send.max(initial=0))) + 2

    def at(position: np.ndarray) -> np.ndarray:
        if not len(srow):
            return np.full(len(position), -1)
        found = np.searchsorted(srow * wide + sstart, row * wide + position, "right") - 1
        held = (found >= 0) & (srow[found] == row) & (position < send[found])
        return np.where(held, found, -1)

    first, last = at(start), at(np.maximum(end - 1, start))
    chosen = first
    if rule == "last":
        chosen = last
    elif rule == "most":
        head = np.where(first >= 0, np.minimum(end, send[first] if len(send) else 0) - start, 0)
        tail = np.where(last >= 0, end - np.maximum(start, sstart[last] if len(sstart) else 0), 0)
        chosen = np.where((first >= 0) & (head >= tail), first, last)
    return chosen, (chosen >= 0) & (first != last)


def attributed(docs: DataFrame, path: str, rule: str = "first", id_col: str = "doc_id", text_col: str = "text",
               sections_col: str | None = None) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing): one row per section of every document, numbered from 0 by position.

    Sections are the lines of the text, or an array column of structs with
    ``start`` and ``end`` (code points, end exclusive); null sections are none, overlapping ones end the job.
    A null text is empty; a document with tokens in no section has one more row,
    section -1. ``n_crossing`` counts allotted tokens that also lie elsewhere.
    Repeated rows are counted each; other columns are not looked at.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in chunks(batch.column(1), PIECE):
                n = len(offsets) - 1
                own = given(batch.column(2).slice(first, n)) if sections_col else lines(data, offsets)
                tokens = token_spans(data, offsets, path)
                chosen, crosses = allocate(tokens, own, rule)
                row, start, end = own
                number = np.arange(len(row)) - np.searchsorted(row, row)
                count = np.bincount(chosen[chosen >= 0], minlength=len(row))
                crossing = np.bincount(chosen[crosses], minlength=len(row))
                lost = np.bincount(tokens[0][chosen < 0], minlength=n)
                more = np.flatnonzero(lost)
                names = batch.column(0).slice(first, n)
                zero = np.full(len(more), -1)
                columns = [np.concatenate(x) for x in (
                    (number, zero), (start, zero * 0), (end, zero * 0), (count, lost[more]), (crossing, zero * 0))]
                yield pa.record_batch(
                    [names.take(pa.array(np.concatenate([row, more]))), pa.array(columns[0].astype(np.int32)), *[pa.array(x.astype(np.int64)) for x in columns[1:]]],
                    ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"],
                )

    columns = [F.col(id_col).cast("long"), F.col(text_col)] + ([F.col(sections_col)] if sections_col else [])
    return docs.select(*columns).mapInArrow(counted, COUNTS)
