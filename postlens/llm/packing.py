"""Vector bin packing of tokenised examples into training sequences (operator 9).

An example weighs (tokens, segments, loss-bearing tokens), and a sequence has a limit in each.
Sequences are filled one at a time: of the waiting examples that fit, the one with
the largest dot product of its weight with the room left goes in (both in units of
the limits). A sequence that no whole example fits any more gets a cut of one
instead, when over ``slack`` of it would stay empty. Examples longer than a
sequence give full sequences first. Each task packs its own documents with a
bounded number waiting, so nothing is shuffled and no task holds more than that.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.bpe import default_path, worker_encoder
from postlens.llm.columns import slices
from postlens.llm.worker import drop, trim

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_NAMES = [x.split()[0] for x in PIECES.split(", ")]


class Packer:
    """Streaming packer: ``add`` examples, then ``finish``; each yields rows of PIECES."""

    def __init__(self, first_sequence: int, max_tokens: int, max_segments: int, max_loss: int, waiting: int, slack: float):
        self.limit = np.array([max_tokens, max_segments, max_loss], float)
        self.next, self.waiting, self.slack = first_sequence, waiting, slack
        self.items: list[tuple] = []  # (doc_id, start, ids, doc_tokens, loss flags)
        self.rows: list[tuple] = []

    def _weight(self, item) -> tuple:
        return len(item[2]), 1, int(item[4].sum())

    def _place(self, item, sequence: int, offset: int) -> int:
        doc, start, ids, total, loss = item
        self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset, int(loss.sum())))
        return offset + len(ids)

    def _cut(self, item, n: int) -> tuple[tuple, tuple]:
        doc, start, ids, total, loss = item
        return (doc, start, ids[:n], total, loss[:n]), (doc, start + n, ids[n:], total, loss[n:])

    def _fits(self, item) -> int:
        """How many of its first ids an empty sequence takes."""
        n = min(len(item[2]), int(self.limit[0]))
        over = np.searchsorted(np.cumsum(item[4][:n]), self.limit[2] + 1)
        return max(1, min(n, int(over)))

    def add(self, doc_id, ids: np.ndarray, loss: np.ndarray) -> None:
        item = (doc_id, 0, ids, len(ids), loss)
        most = int(self.limit[0])
        while len(item[2]) > most or int(item[4].sum()) > self.limit[2]:
            n = self._fits(item)
            head, item = self._cut(item, n)
            if n == most:
                self._place(head, self.next, 0)
                self.next += 1
            else:
                self.items.append(head)
        if len(item[2]) == most:
            self._place(item, self.next, 0)
            self.next += 1
        elif len(item[2]):
            self.items.append(item)
        if len(self.items) >= self.waiting:
            self._fill(self.waiting // 2)

    def _fill(self, leave: int) -> None:
        """Close sequences until at most ``leave`` examples wait."""
        items = self.items
        weight = np.array([self._weight(x) for x in items], float).reshape(-1, 3)
        share = weight / self.limit
        tokens, loss = weight[:, 0].copy(), weight[:, 2].copy()
        alive = np.ones(len(items), bool)
        left = len(items)
        while left > leave:
            room, chosen, offset = self.limit.copy(), [], 0
            fits = np.flatnonzero(alive)
            while True:
                # room only shrinks: what fits now is among what fitted before
                fits = fits[alive[fits] & (tokens[fits] <= room[0]) & (loss[fits] <= room[2])] if room[1] >= 1 else fits[:0]
                if not len(fits):
                    break
                best = fits[np.argmax(share[fits] @ (room / self.limit))]
                chosen.append(best)
                alive[best] = False
                room -= weight[best]
                left -= 1
            gap = int(min(room[0], room[2]))
            if left and room[1] >= 1 and room[0] > self.slack * self.limit[0] and gap >= 1:
                k = np.flatnonzero(alive)[np.argmax(weight[alive][:, 0])]  # the longest that waits
                head, tail = self._cut(items[k], min(gap, len(items[k][2]) - 1)) if len(items[k][2]) > 1 else (None, None)
                if head is not None:
                    items[k] = tail
                    weight[k] = self._weight(tail)
                    share[k] = weight[k] / self.limit
                    tokens[k], loss[k] = weight[k, 0], weight[k, 2]
                    offset = self._place(head, self.next, offset)
            if not left and leave == 0 and room[0] > 0:
                self._last([items[i] for i in chosen])
                break
            for i in chosen:
                offset = self._place(items[i], self.next, offset)
            self.next += 1
        self.items = [x for x, a in zip(items, alive, strict=True) if a]

    def _last(self, chosen: list) -> None:
        """The last, partly filled sequence becomes sequences of powers of two, which need no padding."""
        total = sum(len(x[2]) for x in chosen)
        chosen = chosen[::-1]
        while total:
            size, offset = 1 << (total.bit_length() - 1), 0
            while offset < size:
                item = chosen.pop()
                if len(item[2]) > size - offset:
                    item, tail = self._cut(item, size - offset)
                    chosen.append(tail)
                offset = self._place(item, self.next, offset)
            self.next += 1
            total -= size

    def finish(self) -> None:
        if self.items:
            self._fill(0)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(_NAMES))], _NAMES)


def pack_documents(docs: DataFrame, *, path: str | None = None, end_id: int = 1, max_tokens: int = 2048, max_segments: int = 256,
                   max_loss: int | None = None, waiting: int = 1024, slack: float = 0.01, keep_encoder: bool = True,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every whole text's ids (with ``end_id`` appended), placed in sequences: rows of PIECES.

    A null text is empty and gives its end id alone; rows that share an id are packed each for
    itself; an empty table gives no piece. A document's first id has no context and
    bears no loss. ``sequence_id`` holds the task's number in its high bits.
    Sequences are at most ``max_tokens`` long, of at most ``max_segments`` pieces and
    ``max_loss`` loss-bearing ids (by default ``max_tokens``). Workers keep the encoder for their next
    task unless ``keep_encoder`` is false (then other operators find its memory free).
    """
    if max_tokens < 1 or max_segments < 1 or waiting < 2:
        raise ValueError("max_tokens, max_segments and waiting must be positive")
    path, most_loss = path or default_path(), max_tokens if max_loss is None else max_loss
    if most_loss < 1:
        raise ValueError("max_loss must be positive")

    def run(batches):
        from pyspark import TaskContext

        encoder = worker_encoder(path)
        packer = Packer(TaskContext.get().partitionId() << 36, max_tokens, max_segments, most_loss, waiting, slack)
        for batch in batches:
            keys, texts = batch["id"].to_pylist(), batch["text"]
            for a, b in slices(texts, 1 << 20):
                ids, offsets = encoder.encode(texts.slice(a, b - a))
                for k in range(b - a):
                    own = np.append(ids[offsets[k]:offsets[k + 1]], np.uint32(end_id))
                    loss = np.ones(len(own), bool)
                    loss[0] = False
                    packer.add(keys[a + k], own, loss)
                yield packer.take()
            trim()
        packer.finish()
        yield packer.take()
        if not keep_encoder:
            drop()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)
