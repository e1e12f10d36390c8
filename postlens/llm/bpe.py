"""Byte-level BPE of whole Arrow columns with the tokenizers library.

The tokenizer's own splitter never joins across a single space (or line feed) between
two non-space characters, nor a letter with the punctuation after it. A batch is cut
there, equal units are encoded once (a worker keeps a bounded number of them for
its next batches), and the ids are gathered back. The name of an added token (as
"<|endoftext|>") is a unit of its own, as the library takes it out of a text first. The result equals encoding each text as a whole
(tests/llm/test_llm_tokens.py compares them).
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from postlens.llm.columns import binary_buffers, distinct_values, row_starts, text_buffers
from postlens.llm.worker import kept

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_WIDE_LEAD = np.zeros(256, bool)  # may lead a Unicode space: then no cut is made beside it
_WIDE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)  # ASCII punctuation but for the apostrophe of contractions
_MARK[[i for i in range(33, 127) if not chr(i).isalnum() and i != 39]] = True
_JOIN = 2048


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _solid_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends just before ``at`` is surely no space."""
    b1, b2, b3 = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    return np.where(b1 < 128, ~_WS[b1], ~(_WIDE_LEAD[b2] | _WIDE_LEAD[b3]))


def worker_encoder(path: str) -> Encoder:
    """This Python worker's encoder, kept between its tasks with the units that it has met."""
    return kept(("encoder", path), lambda: Encoder(path))


class Encoder:
    """``encode(column)`` -> (ids of all rows, row offsets)."""

    def __init__(self, path: str, most_units: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens that depend on the text around them are not supported")
        self.names = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.name = re.compile(b"|".join(map(re.escape, self.names)))
        self.size = self.tokenizer.get_vocab_size()
        self.spaced = np.zeros(self.size, bool)  # tokens that begin with a space byte
        for token, i in self.tokenizer.get_vocab().items():
            self.spaced[i] = token.startswith("Ġ")
        # units met before: number of each, and its ids
        self.most_units, self.known = most_units, {}
        self.ids, self.begin, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _named(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """(start, end) of the added tokens' names within the rows."""
        raw, hits = data.tobytes(), []
        for name in self.names:
            at = raw.find(name)
            while at >= 0:
                hits.append(at)
                at = raw.find(name, at + 1)
        rows = np.unique(np.searchsorted(offsets, hits, "right") - 1).tolist() if hits else []
        return [(int(offsets[r]) + m.start(), int(offsets[r]) + m.end()) for r in rows for m in self.name.finditer(raw[offsets[r]:offsets[r + 1]])]

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        first = row_starts(len(data), offsets)
        at = np.flatnonzero((data == 32) | (data == 10))
        at = at[~first[at] & ~first[at + 1]]
        after = data[at + 1]
        at = at[_solid_before(data, at) & ~_WS[after] & ~_WIDE_LEAD[after]]
        at = np.concatenate([at, at[data[at] == 10] + 1])
        # a letter, then punctuation: the splitter always parts them
        mark = np.flatnonzero(_MARK[data])
        before = data[np.maximum(mark - 1, 0)]
        accented = (data[np.maximum(mark - 2, 0)] == 0xC3) & (before >= 128) & (before != 0x97) & (before != 0xB7)
        first[mark[_LETTER[before] | accented]] = True
        first[at] = True
        for a, b in self._named(data, offsets):
            first[a + 1:b] = False
            first[[a, b]] = True
        return np.flatnonzero(first[:-1])

    def _encode_new(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of the distinct units, in any order, with each unit's begin and size there."""
        data, offsets = binary_buffers(units)
        n, starts, ends = len(units), offsets[:-1], offsets[1:]
        spaces = np.add.reduceat(_WS[data].astype(np.int32), starts)
        easy = (data[starts] == 32) & (spaces == 1) & (ends - starts > 1) & _solid_before(data, ends)
        raw = units.to_pylist()
        begin, size = np.zeros(n, np.int64), np.full(n, -1)
        parts, total = [], 0
        at = np.flatnonzero(easy)
        groups = [at[i:i + _JOIN] for i in range(0, len(at), _JOIN)]
        for g, ids in zip(groups, self._plain([b"".join([raw[i] for i in g]).decode() for g in groups]), strict=True):
            ids = np.array(ids, np.uint32)
            heads = np.flatnonzero(self.spaced[ids])
            if len(heads) == len(g):  # else one by one, below
                begin[g], size[g] = total + heads, np.diff(heads, append=len(ids))
                parts.append(ids)
                total += len(ids)
        rest = np.flatnonzero(size < 0)
        lists = self._plain([raw[i].decode() for i in rest])
        size[rest] = [len(x) for x in lists]
        begin[rest] = total + np.cumsum(size[rest]) - size[rest]
        parts.append(np.fromiter((i for x in lists for i in x), np.uint32))
        return np.concatenate(parts), begin, size

    def _encode_units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = units.to_pylist()
        number = np.fromiter((self.known.get(x, -1) for x in raw), np.int64, len(raw))
        new = np.flatnonzero(number < 0)
        if not len(new):
            return self.ids, self.begin[number], self.length[number]
        ids, begin, size = self._encode_new(units.take(pa.array(new)))
        n = len(self.known)
        all_ids, all_begin, all_size = np.concatenate([self.ids, ids]), np.concatenate([self.begin, len(self.ids) + begin]), np.concatenate([self.length, size])
        number[new] = n + np.arange(len(new))
        room = min(len(new), self.most_units - n)
        if room > 0:
            self.known.update(zip([raw[i] for i in new[:room]], range(n, n + room), strict=True))
            self.ids, self.begin, self.length = all_ids, all_begin[:n + room], all_size[:n + room]
        return all_ids, all_begin[number], all_size[number]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_buffers(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts = self._cuts(data, offsets)
        index, units = distinct_values(data, np.append(starts, len(data)))
        ids, begin, size = self._encode_units(units)
        sizes = size[index]
        ends = np.cumsum(sizes)
        flat = ids[np.repeat(begin[index] - (ends - sizes), sizes) + np.arange(ends[-1])]
        return flat, np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]
