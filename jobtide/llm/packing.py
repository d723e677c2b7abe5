"""Hierarchical multi-length packing of tokenised documents.

A document's full windows stand alone. What remains is routed to the smallest context tier that holds it. From the
longest item down, each opens a window of its tier, whose gap is filled with the longest shorter items that fit and
then with the head of a cut one. What is left when the items run out is cut into windows of powers of two, so that no
window needs padding. Windows of a tier are dealt to step groups of equal tokens with balanced attention cost.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import blocks, documents
from .tokens import encoder

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 16 * 2048

PIECES = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "tier", "step_group")] + [T.StructField("ids", T.BinaryType())]
)


class Pool:
    """Items by length; the bits of ``mask`` tell which lengths there are."""

    def __init__(self) -> None:
        self.items: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.mask = 0

    def add(self, length: int, doc: int, start: int) -> None:
        self.items[length].append((doc, start))
        self.mask |= 1 << length

    def take(self, length: int) -> tuple[int, int]:
        found = self.items[length].pop()
        if not self.items[length]:
            self.mask ^= 1 << length
        return found

    def longest(self, most: int) -> int:
        """The length of the longest item of at most ``most``; 0 if there is none."""
        return max(0, (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1)

    def shortest(self) -> int:
        return (self.mask & -self.mask).bit_length() - 1


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (size, pieces) with pieces (document, start, length); every window is exactly full."""
    top, pool, windows = tiers[-1], Pool(), []
    for doc, n in enumerate(lengths):
        windows += [(top, [(doc, at, top)]) for at in range(0, n - top + 1, top)]
        if n % top:
            pool.add(n % top, doc, n - n % top)
    while pool.mask:
        length = pool.longest(top)
        size = next(t for t in tiers if t >= length)
        pieces, gap = [(*pool.take(length), length)], size - length
        while gap and pool.mask:
            length = pool.longest(gap)
            if length:
                pieces.append((*pool.take(length), length))
                gap -= length
            else:
                length = pool.shortest()
                doc, start = pool.take(length)
                pieces.append((doc, start, gap))
                pool.add(length - gap, doc, start + gap)
                gap = 0
        windows += [(size, pieces)] if not gap else _halved(pieces, size - gap)
    return windows


def _halved(pieces: list[tuple[int, int, int]], total: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Pieces of ``total`` tokens dealt to windows of the powers of two that make up the total."""
    windows, left = [], list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        if not total >> bit & 1:
            continue
        need, own = 1 << bit, []
        while need:
            doc, start, length = left.pop()
            own.append((doc, start, min(need, length)))
            if length > need:
                left.append((doc, start + need, length - need))
            need -= own[-1][2]
        windows.append((1 << bit, own))
    return windows


def step_groups(windows: list[tuple[int, list[tuple[int, int, int]]]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each window: one size and at most ``step_tokens`` tokens a group, dealt to and fro by cost (sum of squared lengths)."""
    by, groups, used = defaultdict(list), [0] * len(windows), 0
    for w, (size, pieces) in enumerate(windows):
        by[size].append((-sum(n * n for *_, n in pieces), w))
    for size in sorted(by):
        n = -(-len(by[size]) * size // step_tokens)
        for k, (_, w) in enumerate(sorted(by[size])):
            turn, at = divmod(k, n)
            groups[w] = used + (at if turn % 2 == 0 else n - 1 - at)
        used += n
    return groups


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Pieces of all documents in windows of at most ``tiers[-1]`` tokens.

    A document's tokens are its ids and then ``end_id``; a null or empty text has only ``end_id``. One row a piece:
    doc_id (null stays null), start and length in the document, doc_tokens, sequence_id, offset in the sequence
    (gapless from 0), tier (the sequence's size, always reached), step_group, ids (little-endian unsigned 32-bit).
    Equal ids or texts are packed as often as they occur. Sequences never leave the task that reads their
    documents, so nothing is shuffled; an empty table gives no rows. Spark's partition number leads the sequence and group ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, seq, group = encoder(tokenizer), TaskContext.get().partitionId() << 40, TaskContext.get().partitionId() << 40
        end = np.array([end_id], np.uint32)
        for doc_ids, texts in blocks(batches):
            ids = [np.concatenate([x, end]) for x in e.encode(texts)]
            windows = pack([len(x) for x in ids], tiers)
            groups = step_groups(windows, step_tokens)
            rows = []
            for k, (size, pieces) in enumerate(windows):
                at = 0
                for doc, start, length in pieces:
                    rows.append((doc_ids[doc], start, length, len(ids[doc]), seq + k, at, size, group + groups[k], ids[doc][start : start + length].tobytes()))
                    at += length
            seq, group = seq + len(windows), group + max(groups, default=-1) + 1
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.binary())], names=PIECES.names)

    return documents(docs).mapInArrow(run, PIECES)
