"""Byte-level BPE token ids and counts of whole texts.

Texts are cut into pre-tokens and every distinct pre-token is encoded once. A huge text is encoded in
overlapping chunks: neighbours are spliced at a boundary which both of them have, at which the encoding of
the whole text provably has one too, and an overlap without such a boundary is widened.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import WordStore, blocks, documents

# The pre-token pattern of the byte-level BPE family, and its contractions.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("'s", "'t", "'m", "'d", "'re", "'ve", "'ll")

#: The classes of characters that the pattern tells apart; SEP stands between texts and occurs in none that is cut here.
OTHER, LETTER, NUMBER, SPACE, SEP = range(5)
SEPARATOR = "￿"
#: Beyond this code point, except for general punctuation, texts go to the library as they are.
PLAIN = 0x250
#: A boundary nearer to a chunk's end could still change with the text behind: contractions and special tokens are shorter.
GUARD = 32
CHUNK_CHARS, OVERLAP_CHARS = 65_536, 512


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(0x10000, 255, np.uint8)
    kinds = ((regex.compile(r"\p{L}"), LETTER), (regex.compile(r"\p{N}"), NUMBER), (regex.compile(r"\s"), SPACE))
    for c in [*range(PLAIN), *range(0x2010, 0x2028)]:
        table[c] = next((k for p, k in kinds if p.match(chr(c))), OTHER)
    table[0x1C:0x20] = OTHER  # \s of the library leaves these out
    table[ord(SEPARATOR)] = SEP
    return table


def starts(codes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of separated plain texts begin, separators included."""
    n = len(codes)
    prev, after = np.empty_like(kind), np.empty_like(kind)
    prev[0], prev[1:] = SEP, kind[:-1]
    after[-1], after[:-1] = SEP, kind[1:]
    space = kind == SPACE
    flag = prev != kind
    flag |= space & (after != SPACE) & (after != SEP)  # the last of several white spaces stands alone or leads the next word
    flag[1:] &= ~((codes[:-1] == 32) & ~space[1:] & (kind[1:] != SEP))
    quote = np.flatnonzero((codes == 39) & flag)
    if len(quote):
        padded = np.concatenate([codes, np.full(3, 0xFFFF, codes.dtype)])
        for c in CONTRACTIONS:
            at = quote
            for k, ch in enumerate(c[1:], 1):
                at = at[padded[at + k] == ord(ch)]
            flag[at + 1] = False
            end = at + len(c)
            end = end[end < n]
            flag[end[(kind[end] == LETTER)]] = True
    return np.flatnonzero(flag)


class Encoder:
    """Ids of texts as the library gives them, with a bounded store of encoded pre-tokens."""

    def __init__(self, path: str, most: int = 1_000_000):
        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        byte_of = _bytes_of_letters()
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in byte_of for c in t)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        for t in self.special:
            ranks.pop(t.encode(), None)
        self.bpe = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = WordStore(self.bpe.encode_ordinary, most)

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(boundaries, the text of each, its ids' count, all ids) of texts that hold plain characters only."""
        joined = SEPARATOR.join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        kind = _classes()[codes]
        at = starts(codes, kind)
        end = np.append(at[1:], len(codes))
        owner = np.cumsum(kind[at] == SEP)
        real = kind[at] != SEP
        at, end, owner = at[real], end[real], owner[real]
        count, ids = self.words.ids(joined, codes, at, end)
        offset = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        return at - offset[owner], owner, count, ids

    def is_plain(self, text: str) -> bool:
        return (text.isascii() or _ODD.search(text) is None) and not any(s in text for s in self.special)

    def chunk(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(boundaries, ids' counts, ids) of one piece of text; every boundary is one between pre-tokens."""
        if self.is_plain(text):
            at, _, count, ids = self.plain([text])
            return at, count, ids
        e = self.library.encode(text, add_special_tokens=False)
        ids = np.array(e.ids, np.uint32)
        special = np.isin(ids, [self.library.token_to_id(s) for s in self.special])
        word = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
        new = np.ones(len(ids), bool)
        new[1:] = (word[1:] != word[:-1]) | special[1:] | special[:-1]
        first = np.flatnonzero(new)
        begin = np.array([o[0] for o in e.offsets], np.int64)[first]
        return begin, np.diff(np.append(first, len(ids))), ids

    def huge(self, text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> np.ndarray:
        """Ids of a text in overlapping chunks.

        From a boundary on, the encoding depends only on what follows. The left chunk starts at a true boundary,
        so each of its boundaries which lies at least GUARD before its end is true. Where the right chunk has
        that boundary too, its ids from there on are those of the whole text.
        """
        out, a, n = [], 0, len(text)
        while True:
            b, step = min(n, a + size), overlap
            while True:
                at, count, ids = self.chunk(text[a:b])
                if b == n:
                    return np.concatenate([*out, ids])
                right = max(a, b - step)
                other = self.chunk(text[right : min(n, b + GUARD)])[0] + right
                both = np.intersect1d(at + a, other)
                both = both[(both > max(a, right)) & (both <= b - GUARD)]
                if len(both):
                    break
                b, step = min(n, b + 2 * step), 2 * step
            p = int(both[-1])
            out.append(ids[: int(count[: np.searchsorted(at, p - a)].sum())])
            a = p

    def encode(self, texts: list[str], chunk: int = CHUNK_CHARS) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        small = []
        for i, t in enumerate(texts):
            if len(t) > chunk:
                out[i] = self.huge(t, chunk)
            elif t and self.is_plain(t):
                small.append(i)
            elif t:
                out[i] = self.chunk(t)[2]
        if small:
            _, owner, count, ids = self.plain([texts[i] for i in small])
            ends = np.cumsum(np.bincount(owner, weights=count, minlength=len(small)).astype(np.int64))
            for k, i in enumerate(small):
                out[i] = ids[ends[k - 1] if k else 0 : ends[k]]
        return out


_ODD = regex.compile(f"[^\\x00-{chr(PLAIN - 1)}‐-‧]")


def _bytes_of_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """Tokens of every whole text.

    Returns doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), one row for each input row, repeated ids
    included. A null or empty text has 0 tokens; a null id stays null. No shuffle: a text stays in its task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for ids, texts in blocks(batches):
            n = [len(x) for x in e.encode(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_tokens")])
    return documents(docs).mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


__all__ = ["Encoder", "count_tokens", "encoder"]
