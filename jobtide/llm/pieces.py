"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces runs once over the text. At each position its output links give
every piece that ends there, and each relaxes the best path to that position. For a unigram model
the best path has the largest sum of scores. For a merge (BPE) model the largest sum is not what the library gives:
there a path is right if and only if each two neighbours are what merging gives for them together, so the score of a step
is nothing or minus infinity, and exactly one piece survives at each position that ends a piece.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import WordStore, blocks, documents

MARK = "▁"
#: Merge checks of pairs of pieces that a worker keeps.
MOST_PAIRS = 200_000
#: Characters from here on are never told apart when the text is cut.
WIDE = 1023


class PieceModel:
    def __init__(self, path: str, kind: str = "auto", most: int = 300_000):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.merging = kind == "bpe" or kind == "auto" and all(s <= 0 and s == int(s) for s in self.score.values())
        self.machine = ahocorasick.Automaton()
        for p in self.ids:
            self.machine.add_word(p, p)
        self.machine.make_automaton()
        self.floor = min(self.score.values(), default=0.0) - 10.0
        self.pairs: dict[tuple[str, str], bool] = {}
        #: Which neighbours stand together in some piece. Between others no piece reaches across, so the text can be cut there.
        self.joined = np.zeros((WIDE + 1, WIDE + 1), bool)
        self.joined[WIDE], self.joined[:, WIDE] = True, True
        for p in self.ids:
            c = self._codes(p)
            self.joined[c[:-1], c[1:]] = True
        self.own_rule = sp.normalize("  a  b\tﬁ ") == MARK + "  a  b\tﬁ ".replace(" ", MARK) if hasattr(sp, "normalize") else True
        self.store = WordStore(self.encode_word, most)
        byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        self.surface = [byte_of.get(i, b"" if sp.is_control(i) else sp.id_to_piece(i).replace(MARK, " ").encode()) for i in range(n)]

    def _codes(self, s: str) -> np.ndarray:
        c = np.frombuffer(s.encode("utf-32-le"), np.uint32)
        return np.where(c == ord(MARK), WIDE - 1, np.minimum(c, WIDE))

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        return MARK + text.replace(" ", MARK) if self.own_rule else self.library.normalize(text)

    def merged(self, s: str) -> list[str]:
        """What merging makes of a short string: the best-scored pair first, the leftmost of equals."""
        parts, score = list(s), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                x = score.get(parts[i] + parts[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def path(self, s: str) -> list[str]:
        """The pieces of ``s``, and single characters that are none."""
        n = len(s)
        last: list[str | None] = [None] * (n + 1)
        last[0] = ""
        best = [0.0] * (n + 1)
        matches = self.machine.iter(s)
        at = next(matches, None)
        for end in range(n):
            single, seen = s[end], False
            while at is not None and at[0] == end:
                p = at[1]
                seen |= len(p) == 1
                self._relax(last, best, end + 1, p, self.score[p])
                at = next(matches, None)
            if not seen:
                self._relax(last, best, end + 1, single, self.floor)
        out, end = [], n
        while end:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def _relax(self, last: list[str | None], best: list[float], end: int, piece: str, score: float) -> None:
        begin = end - len(piece)
        before = last[begin]
        if before is None:
            return
        if self.merging:
            if last[end] is None and self.fits(before, piece):
                last[end] = piece
        elif last[end] is None or best[begin] + score > best[end]:
            last[end], best[end] = piece, best[begin] + score

    def encode_word(self, s: str) -> list[int]:
        out = []
        for p in self.path(s):
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            else:
                out.append(self.library.unk_id())
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        normal = [self.normalise(t) for t in texts]
        joined = "".join(normal)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        size = np.array([len(t) for t in normal], np.int64)
        first = np.cumsum(size) - size
        if not len(codes):
            return [np.zeros(0, np.uint32)] * len(texts)
        flag = np.zeros(len(codes), bool)
        near = self._codes(joined)
        flag[1:] = ~self.joined[near[:-1], near[1:]]
        flag[first[size > 0]] = True
        at = np.flatnonzero(flag)
        count, ids = self.store.ids(joined, codes, at, np.append(at[1:], len(codes)))
        owner = np.searchsorted(first + size, at, side="right")
        ends = np.cumsum(np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64))
        return np.split(ids, ends[:-1])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the mark that encoding puts in front."""
        surface = self.surface
        text = b"".join([surface[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every whole text, however long; a null or empty text has none.

    One row for each input row, repeated ids and texts included; null ids stay null; an empty table gives no rows; other columns are left out. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for doc_ids, texts in blocks(batches, 1_000_000):
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([x.tobytes() for x in m.encode(texts)], pa.binary())], names=["doc_id", "ids"])

    return documents(docs).mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())]))


def decode_pieces(encoded: DataFrame, path: str, *keep: str) -> DataFrame:
    """(doc_id, ids, ``keep``...) to (doc_id, text, ``keep``...), row by row; null ids give a null text, no ids an empty one, a null doc_id stays null; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [None if x.as_py() is None else m.decode(np.frombuffer(x.as_py(), np.uint32)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *batch.columns[2:]], names=["doc_id", "text", *keep])

    rows = encoded.select("doc_id", "ids", *keep)
    kept = [rows.schema[c] for c in keep]
    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *kept]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, text_sha256 of the decoded text, one row for each input row. A null text counts as empty, a null id stays null; an empty table gives no rows.

    Encoding and decoding are one Python pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for doc_ids, texts in blocks(batches, 500_000):
            ids = m.encode(texts)
            made = [[len(x) for x in ids], [zlib.crc32(x.tobytes()) for x in ids]]
            digests = [hashlib.sha256(m.decode(x).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *(pa.array(c, pa.int64()) for c in made), pa.array(digests, pa.string())], names=["doc_id", "n_pieces", "ids_crc32", "text_sha256"])

    return documents(docs).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, text_sha256 string")
