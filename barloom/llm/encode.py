"""Token ids of whole texts by a public tokenizer, at the speed of its words.

Both tokenizers encode the stretches between single blanks one by one, and a
run of letters ends at the next mark or digit, so a text is cut there, each
distinct stretch is encoded once by the tokenizers
library and looked up afterwards. Where white space is anything but a single
blank or line feed between visible characters, the cut is left out, and a text
with unusual white space or control characters goes through the library whole.
The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)`` as the
file sets it up: a text that holds the string of an added token is one of those
that go through whole. The store of known stretches is
bounded and is per Python worker.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from barloom.llm.words import Spans, chunks

#: distinct stretches kept by one worker, and the bytes of one kept stretch
KNOWN, LONGEST = 1 << 21, 64
#: bytes of text encoded at once; new stretches are sorted in once per piece
PIECE = 1 << 20
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK = np.zeros(256, bool)
MARK[0x21:0x7F] = True
MARK &= ~LETTER
#: candidates for the text between stretches that are encoded in one call
DIVIDERS = ("\n", " ~ ")
UNUSUAL = re.compile("[\x00-\x08\x0b-\x1f\x7f-\xa0 ᠎ -‏ -  -⁤　﻿]")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_padding()
    found.no_truncation()
    return found


class Encoder:
    """Known stretches as sorted hashes with their ids in one flat array."""

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizer(path)
        self.between = self.divider()
        #: added tokens by their text, in lower case since a normalizer may come first
        self.added = [x.content.lower().encode() for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(texts), 256):
            out += [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(texts[at : at + 256], add_special_tokens=False)]
        return out

    def divider(self) -> tuple[str, int] | None:
        """Text that stands between stretches as a token of its own, and its id."""
        for text in DIVIDERS:
            ids, alone = self.tokenizer.encode(f"a.{text}b", add_special_tokens=False).ids, self.plain(["a.", "b"])
            middle = ids[len(alone[0]) : len(ids) - len(alone[1])]
            if len(middle) == 1 and ids == [*alone[0], *middle, *alone[1]]:
                return text, middle[0]
        return None

    def joined(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of many stretches from few calls: a call costs as much as some ten tokens."""
        if self.between is None:
            return self.plain(texts)
        text, mark = self.between
        inner = text.strip() or text
        easy = [i for i, x in enumerate(texts) if inner not in x and (len(x) < 2 or x[1:].split() == [x[1:]]) and x.strip() and x[0] not in "\n\t"]
        out: list[np.ndarray | None] = [None] * len(texts)
        for at in range(0, len(easy), 4096):
            own = easy[at : at + 4096]
            ids = np.array(self.tokenizer.encode(text.join(texts[i] for i in own), add_special_tokens=False).ids, np.int32)
            at = np.flatnonzero(ids == mark).tolist()
            if len(at) + 1 == len(own):
                for i, a, b in zip(own, [-1, *at], [*at, len(ids)], strict=True):
                    out[i] = ids[a + 1 : b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.plain([texts[i] for i in rest]), strict=True):
            out[i] = x
        return out

    def learn(self, keys: np.ndarray, texts: list[str]) -> None:
        ids = self.joined(texts)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(size.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(total, len(self.ids)), np.int32)])
        self.ids[self.used : self.used + total] = np.concatenate(ids)
        first = self.used + np.cumsum(size) - size
        self.used += total
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.first = np.concatenate([self.first, first])[order]
        self.size = np.concatenate([self.size, size])[order]

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the rows and where each row's ids begin."""
        raw = data.tobytes()
        rows = len(offsets) - 1
        blank, feed = data == 0x20, data == 0x0A
        visible = ~(blank | feed | (data == 9))
        around = np.zeros(len(data), bool)
        around[1:-1] = visible[:-2] & visible[2:]
        cut = np.zeros(len(data) + 1, bool)
        cut[:-1] = (blank | feed) & around  # before a lone blank or line feed
        cut[1:] |= feed & around  # and after the line feed
        if len(data) > 1:
            letter = LETTER[data]
            #: two-byte letters from U+00C0 on, without the signs among them
            letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            cut[1:-1] |= letter[:-1] & MARK[data[1:]]
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        first = np.searchsorted(starts, offsets)
        spans = Spans.__new__(Spans)
        spans.data, spans._sums = data, None
        keys = spans.hashes(starts, ends)
        odd = np.zeros(rows, bool)
        if (data >= 0x7F).any() or (data < 0x20).any():
            for row in range(rows):
                piece = raw[offsets[row] : offsets[row + 1]]
                odd[row] = UNUSUAL.search(piece.decode("utf-8", "surrogatepass")) is not None
        low = raw.lower()
        if any(x in low for x in self.added):
            for row in np.flatnonzero(~odd).tolist():
                piece = raw[offsets[row] : offsets[row + 1]].lower()
                odd[row] = any(x in piece for x in self.added)
        aside = np.repeat(odd, np.diff(first)) | (ends - starts > LONGEST)
        kept = np.flatnonzero(~aside)
        distinct, sample = np.unique(keys[kept], return_index=True)
        if len(self.keys) > KNOWN:
            self.clear()
        place = np.searchsorted(self.keys, distinct)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == distinct[known]
        new = np.flatnonzero(~known)
        if len(new):
            at = kept[sample[new]]
            self.learn(distinct[new], [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        place = np.searchsorted(self.keys, keys[kept])
        size, begin = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        size[kept], begin[kept] = self.size[place], self.first[place]
        ids, extra = self.ids[: self.used], []
        alone = np.flatnonzero(aside & ~np.repeat(odd, np.diff(first)))
        whole = np.flatnonzero(odd)
        if len(alone) or len(whole):
            at = np.concatenate([alone, first[whole]])
            texts = [raw[a:b].decode() for a, b in zip(starts[alone].tolist(), ends[alone].tolist(), strict=True)]
            texts += [raw[a:b].decode() for a, b in zip(offsets[whole].tolist(), offsets[whole + 1].tolist(), strict=True)]
            extra = self.plain(texts)
            long = np.fromiter(map(len, extra), np.int64, len(extra))
            size[at], begin[at] = long, len(ids) + np.cumsum(long) - long
            ids = np.concatenate([ids, *extra])
        sums = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=sums[1:])
        flat = ids[np.arange(sums[-1]) + np.repeat(begin - sums[:-1], size)]
        return flat, sums[first]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(texts: pa.Array, path: str):
    """(first row, flat ids, offsets of the rows' ids) per chunk of a batch; a null text is empty."""
    known = encoder(path)
    for row, data, offsets in chunks(texts, PIECE):
        ids, begins = known.chunk(data, offsets)
        yield row, ids, begins
