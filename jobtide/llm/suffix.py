"""Exact removal of repeated byte strings, by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Each window of ``length`` bytes has an anchor: the k-gram in it with the smallest hash, the last of equals. Equal windows
have equal anchors at equal offsets, so windows only have to be compared within the group of an anchor's content. The
windows of one anchor occurrence form a span of bytes. Spans of equal content repeat as a whole; that needs no bytes. One span of each
content of a group that holds several is brought together, their suffixes are sorted, and backward extension on the
transform sets the common prefixes by increasing value up to the length; neighbours that it never sets apart repeat. A group of more
contents than a task should hold is not brought together: the hashes of its windows are counted, which combines before the shuffle.

Anchors that only one span has are left out first. Anchors that very many spans have are known from a sample, and their rows are dealt to several parts;
the rest of the work groups by counts that combine before the shuffle, so no task ever holds a large group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stretches, blocks, discard, made, mix, powers, ragged, scratch, signed, sliced, small_batches, written

LENGTH = 200
#: Window starts of a text that are handled at once; the positions of a unit fit into 24 bits.
UNIT = 1_000_000
#: Characters of texts whose spans are found together.
BLOCK_CHARS = 400_000
#: Bytes of spans whose suffixes are sorted together.
CHUNK_BYTES = 700_000
#: Groups of more contents are compared by counts of their windows' hashes. The results are the same; a task then holds at most so many spans of a group.
HOT_SPANS = 1_000
#: An anchor that HOT_SEEN spans of about HOT_SAMPLE documents have is hot: it is shared for sure, and its rows are dealt to SALTS parts. At most
#: HOT_SAMPLE / HOT_SEEN anchors for each span of a document are. This decides how rows are dealt, never what is found.
HOT_SAMPLE, HOT_SEEN, SALTS = 20_000, 20, 256
#: Bytes of spans whose windows are hashed together.
HASH_BYTES = 300_000
_POSITION = np.uint64((1 << 24) - 1)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).reshape(-1)
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


class Spans:
    """The spans of a run of byte strings: text number, first byte, length, offset of the anchor, hashes of anchor and content."""

    def __init__(self, texts: list[bytes], length: int = LENGTH):
        units = [(i, a) for i, t in enumerate(texts) for a in range(0, max(0, len(t) - length + 1), UNIT)]
        parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2]
        run: list[tuple[int, int]] = []
        size = 0
        for u in [*units, None]:
            if run and (u is None or size + len(texts[u[0]]) > UNIT):
                parts.append(self._of(texts, run, length))
                run, size = [], 0
            if u is not None:
                run.append(u)
                size += min(UNIT + length, len(texts[u[0]]) - u[1])
        self.text, self.start, self.size, self.offset, self.anchor, self.content = (np.concatenate(c) for c in zip(*parts, strict=True))

    @staticmethod
    def _of(texts: list[bytes], units: list[tuple[int, int]], length: int) -> list[np.ndarray]:
        k = length // 2
        w = length - k + 1
        pieces = [texts[i][a : a + UNIT + length - 1] for i, a in units]
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces], np.int64)
        first = np.cumsum(sizes) - sizes
        unit = np.repeat(np.arange(len(pieces)), sizes)
        stretches = Stretches(data)
        at = np.arange(len(data) - k + 1)
        gram = (stretches.sums[k:] - stretches.sums[: len(at)]) * powers(len(data) + 1)[1][: len(at)]
        gram = mix(gram)
        low = _sliding_min((gram & ~_POSITION) | (_POSITION - at.astype(np.uint64)), w)
        starts = np.flatnonzero(np.arange(len(low)) + length <= (first + sizes)[unit[: len(low)]])
        pos = (_POSITION - (low[starts] & _POSITION)).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (pos[1:] != pos[:-1]) | (unit[starts[1:]] != unit[starts[:-1]])
        lead = np.flatnonzero(new)
        last = np.append(lead[1:], len(starts)) - 1
        s1, s2, pos = starts[lead], starts[last], pos[lead]
        offset, size = pos - s1, s2 - s1 + length
        content = mix(stretches.hashes(s1, s1 + size) + offset.astype(np.uint64))
        owner = unit[s1]
        numbers, bases = (np.array(c, np.int64) for c in zip(*units, strict=True))
        return [numbers[owner], s1 - first[owner] + bases[owner], size, offset, gram[pos], content]

    def once(self) -> tuple[np.ndarray, np.ndarray]:
        """One span of each (text, content), and whether the text has that content again."""
        order = np.lexsort((self.content, self.text))
        t, c = self.text[order], self.content[order]
        new = np.ones(len(order), bool)
        new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
        lead = np.flatnonzero(new)
        return order[lead], np.diff(np.append(lead, len(order))) > 1


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes ordered by their first ``depth`` symbols at least, by doubling the compared length."""
    n = len(codes)
    rank, h = codes.astype(np.int64), 1
    word = np.zeros(n + 8, np.int64)
    word[:n] = codes
    key = np.zeros(n, np.int64)
    for i in range(6):  # six symbols of nine bits fit into a word
        key = key << 9 | word[i : i + n]
    order, h = np.argsort(key), 6
    while True:
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        if h >= depth or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: n - h] = rank[h:] + 1
        key = rank * (n + 1) + after
        order, h = np.argsort(key), 2 * h


def repeated(codes: np.ndarray, length: int) -> np.ndarray:
    """Positions whose first ``length`` symbols also start elsewhere; symbols are below 512, the last is 0 and the only 0.

    Common prefixes are set by increasing value. An interval of suffixes that share a prefix is extended backward by each
    symbol in front of it; the boundary behind the extended interval, where it is not yet set, gets the prefix's length and the
    interval goes on. After ``length`` rounds the unset boundaries lie between suffixes that share at least ``length`` symbols.
    """
    n = len(codes)
    order = suffix_order(codes, length)
    front = codes[order]
    bwt = codes[order - 1]
    forward = np.empty(n, np.int64)  # where the suffix one symbol longer stands
    forward[np.argsort(bwt.astype(np.uint16), kind="stable")] = np.arange(n)
    of = np.zeros(n, np.int32)
    unset = np.ones(n + 1, bool)
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(lo):
            break
        size = hi - lo
        f = forward[ragged(lo, size)]
        of[f] = np.repeat(np.arange(len(lo)), size)
        f = np.sort(f)
        # the extensions of an interval by one symbol stand together
        new = np.ones(len(f), bool)
        new[1:] = (f[1:] != f[:-1] + 1) | (of[f[1:]] != of[f[:-1]]) | (front[f[1:]] != front[f[:-1]])
        begin = f[new]
        end = f[np.append(np.flatnonzero(new)[1:] - 1, len(f) - 1)] + 1
        fresh = unset[end]
        lo, hi = begin[fresh], end[fresh]
        unset[hi] = False
    same = np.flatnonzero(unset[1:n]) + 1
    out = np.zeros(n, bool)
    out[order[same]] = True
    out[order[same - 1]] = True
    return out


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _packed(start: np.ndarray, size: np.ndarray, offset: np.ndarray, again: np.ndarray, length: int) -> np.ndarray:
    return start << 24 | (size - length) << 13 | offset << 1 | again


def _unpacked(p: Column, length: int) -> list[Column]:
    return [F.shiftright(p, 24).alias("start"), (F.shiftright(p, 13).bitwiseAND(2047) + length).alias("size"), F.shiftright(p, 1).bitwiseAND(4095).alias("offset"), p.bitwiseAND(1).alias("again")]


def _hashed(texts: list[bytes], keys: list[dict], length: int) -> tuple[Spans, list[dict], np.ndarray]:
    """Spans of the distinct texts, these texts' keys, and how often each text stands here."""
    first: dict[tuple[int, int], int] = {}
    count: list[int] = []
    one: list[int] = []
    for i, k in enumerate(keys):
        at = first.setdefault((k["t"], k["u"]), len(one))
        if at == len(one):
            one.append(i)
            count.append(0)
        count[at] += 1
    return Spans([texts[i] for i in one], length), [keys[i] for i in one], np.array(count, np.int64)


def _keyed(texts: DataFrame) -> DataFrame:
    return texts.select(F.struct("t", "u"), "text")


def anchors(texts: DataFrame, length: int) -> DataFrame:
    """(anchor, content, t, u, span) of every span of (t, u, text); copies within a block of texts count as one that repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, values in blocks(batches, BLOCK_CHARS):
            s, keys, count = _hashed([v.encode() for v in values], keys, length)
            one, again = s.once()
            again = again | (count > 1)[s.text[one]]
            packed = _packed(s.start[one], s.size[one], s.offset[one], again.astype(np.int64), length)
            t, u = (np.array([k[c] for k in keys], np.int64)[s.text[one]] for c in "tu")
            yield pa.RecordBatch.from_arrays([pa.array(signed(s.anchor[one])), pa.array(signed(s.content[one])), pa.array(t), pa.array(u), pa.array(packed)], names=["anchor", "content", "t", "u", "span"])

    return _keyed(texts).mapInArrow(run, "anchor long, content long, t long, u long, span long")


def _bytes_of_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, u, text, marks) to (key, t, u, start, bytes). Copies of a text that stand together, as a join leaves them, count once."""
    last = None
    for b in sliced(batches):
        out: list[tuple] = []
        for t, u, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
            if (t, u) == last:
                continue
            last = t, u
            data = text.as_py().encode()
            out += [(s["anchor"], t, u, s["start"], data[s["start"] : s["start"] + s["size"]]) for s in spans]
        columns = list(zip(*out, strict=True)) if out else [(), (), (), (), ()]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], names=["key", "t", "u", "start", "bytes"])


def _contexts(rows: DataFrame) -> DataFrame:
    """(t, u, text, marks) to (key, t, u, start, bytes): the bytes of each span."""
    return rows.mapInArrow(_bytes_of_spans, "key long, t long, u long, start long, bytes binary")


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """(t, u, text, marks) to (hash, t, u, start, i): the i-th window of each span. One Python pass makes both the spans and their windows."""

    def solve(t: list[int], u: list[int], start: list[int], parts: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(p) for p in parts], np.int64)
        count = sizes - length + 1
        at = ragged(np.cumsum(sizes) - sizes, count)
        h = Stretches(np.frombuffer(b"".join(parts), np.uint8)).hashes(at, at + length)
        columns = [signed(h), *(np.repeat(np.array(c, np.int64), count) for c in (t, u, start)), ragged(np.zeros(len(count), np.int64), count)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["hash", "t", "u", "start", "i"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: list[list] = [[], [], [], []]
        size = 0
        for batch in _bytes_of_spans(batches):
            for _, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for held, x in zip(lists, row, strict=True):
                    held.append(x)
                size += len(row[-1])
                if size > HASH_BYTES:
                    yield solve(*lists)
                    lists, size = [[], [], [], []], 0
        if size:
            yield solve(*lists)

    return rows.mapInArrow(run, "hash long, t long, u long, start long, i long")


def _counted(rows: DataFrame, length: int) -> DataFrame:
    """_compared for the spans of hot groups, from (t, u, text, marks). Counts combine before the shuffle and a common window is joined by adaptive skew handling, so no task holds a group."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            count, i = pa.compute.list_value_length(lists).to_numpy(), lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(count)), count)
            new, last = np.ones(len(i), bool), np.ones(len(i), bool)
            new[1:] = (i[1:] != i[:-1] + 1) | (row[1:] != row[:-1])
            last[:-1] = new[1:]
            row = row[new]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(b.column(2).to_numpy()[row] + i[new]), pa.array(i[last] - i[new] + length)], names=["t", "u", "start", "size"])

    windows = written(_windows(rows, length))
    # copies of a text bring equal windows, and these do repeat
    common = windows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    found = windows.join(written(common), "hash").groupBy("t", "u", "start").agg(F.sort_array(F.collect_set("i")).alias("found"))
    return found.mapInArrow(merge, "t long, u long, start long, size long")


def _compared(contexts: DataFrame, length: int) -> DataFrame:
    """(t, u, start, size) of the repeated stretches among the spans of each key."""

    def solve(t: list[int], u: list[int], start: list[int], parts: list[bytes]) -> pa.RecordBatch:
        codes = np.frombuffer(b"\x00".join(parts) + b"\x00\x00", np.uint8).astype(np.int64) + 2
        sizes = np.array([len(p) for p in parts], np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1
        codes[first + sizes] = 1  # between spans
        codes[-1] = 0
        found = repeated(codes, length)
        ok = np.zeros(len(codes), bool)
        ok[ragged(first, np.maximum(sizes - length + 1, 0))] = True
        a, b = _runs(found & ok)
        part = np.searchsorted(first, a, side="right") - 1
        # runs of windows never reach from one span to the next: a span's last window ends at its last byte
        ts, us, ss = (np.array(c, np.int64)[part] for c in (t, u, start))
        return pa.RecordBatch.from_arrays([pa.array(ts), pa.array(us), pa.array(ss + a - first[part]), pa.array(b - a + length - 1)], names=["t", "u", "start", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: list[list] = [[], [], [], []]
        size, last = 0, None
        seen: set[tuple] = set()
        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != last and size > CHUNK_BYTES:
                    yield solve(*lists)
                    lists, size = [[], [], [], []], 0
                if k != last:
                    seen.clear()
                last = k
                if tuple(row[:3]) in seen:  # copies of a text bring the same spans
                    continue
                seen.add(tuple(row[:3]))
                for held, x in zip(lists, row, strict=True):
                    held.append(x)
                size += len(row[-1]) + 1
        if size:
            yield solve(*lists)

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(run, "t long, u long, start long, size long")


def _by_text(rows: DataFrame, path: str | None = None) -> DataFrame:
    """The set of ``rows``' values of each text (t, u). Copies of a text bring equal rows, which count once. Written, so that a text with very many copies is split in a join."""
    return written(rows.groupBy("t", "u").agg(F.collect_set("mark").alias("marks")), path)


def repeats(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(t, u, mark): stretches of the texts (t, u, text) that repeated strings cover; mark holds start, size and a last bit.

    Where the bit is set the text may have the same content again itself; of such contents only the first stretch is given.
    """
    again = F.col("span").bitwiseAND(1)
    some = texts.where(F.pmod("t", F.lit(max(1, texts.count() // HOT_SAMPLE))) == 0)
    hot_anchors = written(anchors(some, length).groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_SEEN).select("anchor", F.lit(True).alias("hot")))
    every = anchors(texts, length).join(F.broadcast(hot_anchors), "anchor", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("t"), F.lit(SALTS))).otherwise(0))
    weight = F.sum(1 + again).over(Window.partitionBy("anchor", "salt"))
    rows = written(every.withColumn("weight", weight).where(F.col("hot").isNotNull() | (F.col("weight") > 1)).select("anchor", "content", "t", "u", "span"))
    contents = written(rows.groupBy("anchor", "content").agg(F.sum(1 + again).alias("own"), F.min(F.struct("t", "u", "span")).alias("lead")))
    whole = rows.join(contents.where("own > 1").select("anchor", "content"), ["anchor", "content"], "left_semi")
    found = whole.select("t", "u", *_unpacked(F.col("span"), length)).select("t", "u", "start", "size", "again")
    # a group of one content, or of contents that all have several members, has nothing left to compare
    groups = contents.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if(F.col("own") == 1).alias("singles")).where("n > 1 and singles > 0")
    # written, so that both sides of the join are read and a hot anchor is split by adaptive skew handling
    compared = written(contents.join(written(groups.select("anchor", "n")), "anchor").select("anchor", "n", "lead.*"))

    def at_texts(of: Column) -> DataFrame:
        wanted = compared.where(of).select("t", "u", F.struct("anchor", *_unpacked(F.col("span"), length)[:2]).alias("mark"))
        return texts.join(_by_text(wanted), ["t", "u"]).select("t", "u", "text", "marks")

    hot, none = F.col("n") > HOT_SPANS, F.lit(0).cast("long")
    found = found.unionByName(_compared(_contexts(at_texts(~hot)), length).withColumn("again", none))
    if compared.where(hot).limit(1).count():
        found = found.unionByName(_counted(at_texts(hot), length).withColumn("again", none))
    return found.select("t", "u", F.shiftleft("start", 24).bitwiseOR(F.shiftleft("size", 1)).bitwiseOR(F.col("again")).alias("mark"))


def cleaned(docs: DataFrame, *keep: str, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """Remove each byte that a ``length``-byte string covers which also starts anywhere else, the same text included.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the remaining bytes, and with
    ``keep_text`` the remaining text (kept), without characters that lost some of their bytes; then the columns ``keep`` as they are. One row for each input row; a null text counts as
    empty; strings never reach across texts; all is judged on the input. Copies of a text are removed as a whole in each row, if long enough.
    Texts are told apart by 128 bits. Strings are compared as bytes where contents differ; whole spans of equal anchors, and windows of hot
    groups, by 64-bit hashes of at most 2 * ``length`` bytes.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("t"), F.xxhash64(F.lit("u"), text).alias("u"), text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).alias(f"carried_{i}") for i, c in enumerate(keep)])
    path = scratch(docs.sparkSession)
    before = made()
    marks = _by_text(repeats(rows.select("t", "u", "text"), length), path)
    discard(docs.sparkSession, *[p for p in made() if p not in before])

    def own_repeats(x: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Spans whose content the text has more than once."""
        s = Spans([x], length)
        _, inverse, count = np.unique(s.content, return_inverse=True, return_counts=True)
        again = count[inverse] > 1
        return s.start[again], s.size[again]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out = []
            for text, marks in zip(b.column(1), b.column(2), strict=True):
                x = text.as_py().encode()
                kept, gone, runs = x, 0, 0
                if marks.is_valid:
                    m = marks.values.to_numpy()
                    start, size = m >> 24, m >> 1 & (1 << 23) - 1
                    if (m & 1).any():
                        more = own_repeats(x)
                        start, size = np.concatenate([start, more[0]]), np.concatenate([size, more[1]])
                    depth = np.bincount(start, minlength=len(x) + 1) - np.bincount(start + size, minlength=len(x) + 1)
                    covered = np.cumsum(depth)[:-1] > 0
                    gone, runs = int(covered.sum()), len(_runs(covered)[0])
                    kept = np.frombuffer(x, np.uint8)[~covered].tobytes()
                row = [len(x), gone, runs, hashlib.sha256(kept).hexdigest()]
                out.append([*row, kept.decode("utf-8", "ignore")] if keep_text else row)
            columns = list(zip(*out, strict=True)) if out else [()] * (4 + keep_text)
            kinds = [pa.int64()] * 3 + [pa.string()] * (1 + keep_text)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), *b.columns[3:]], names=schema.names)

    fields = [T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType()), *[T.StructField("kept", T.StringType())] * keep_text]
    schema = T.StructType([*fields, *docs.select(*keep).schema.fields])
    carried = [f"carried_{i}" for i in range(len(keep))]
    return rows.join(marks, ["t", "u"], "left").select("doc_id", "text", "marks", *carried).mapInArrow(run, schema)
