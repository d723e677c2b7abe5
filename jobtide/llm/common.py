"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text handled at once inside a task, whatever the size of an Arrow batch.
BLOCK_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where none is set, a local session gets a temporary one; on a cluster that is an error, as executors would write to their own disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="jobtide-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Paths given out by ``scratch`` and not deleted yet, in order.
_made: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/jobtide/{uuid.uuid4().hex}"
    _made.append(path)
    return path


def made() -> list[str]:
    """The paths of written tables that have not been discarded."""
    return list(_made)


#: Spark deletes a query's shuffle files as the query ends; else they stay until the driver happens to collect its garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Queries that end within leave no shuffle files: of an operator's many queries only one's are on disk at a time.

    For queries that run once. Files that are needed again all the same are made again, as after the loss of an executor.
    """
    was = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_CONF) if was is None else spark.conf.set(CLEANUP_CONF, was)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it again.

    A lost executor then costs only the tasks it ran, the planner knows the table's true size, and the shuffle files that made it go.
    """
    path = path or scratch(df.sparkSession)
    with released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(conf).delete(where, True)
        if p in _made:
            _made.remove(p)


#: Bytes of an Arrow batch between Spark and Python: texts are long, and batches of 10,000 of them would fill a task's memory.
ARROW_BYTES, ARROW_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by their bytes, unless the session has a bound of its own."""
    if spark.conf.get(ARROW_CONF, None) is None:
        spark.conf.set(ARROW_CONF, str(ARROW_BYTES))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id long, text string), so that no other column's name can clash with an operator's own."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def with_columns(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id long, text string) and then the columns ``keep``, which may have those names again."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)


def blocks(batches: Iterator[pa.RecordBatch], chars: int = BLOCK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Runs of (ids, texts) of about ``chars`` characters; a null text counts as empty."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = t.as_py() or ""
            if texts and size + len(t) > chars:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if texts:
        yield ids, texts


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows: what a task makes of rows with texts stays small, whatever the size of an Arrow batch."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) for each run of rows that agree in the first ``keys`` columns, which are integers; a run ends with its batch."""
    for b in batches:
        if b.num_rows:
            k = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(keys)])
            cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                yield tuple(k[:, lo].tolist()), b.slice(lo, hi - lo)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) for each group of sorted rows; a group is held, so its size must be bounded."""
    last, held = None, []
    for key, part in runs(batches, keys):
        if held and key != last:
            yield last, pa.concat_batches(held)
            held = []
        last = key
        held.append(part)
    if held:
        yield last, pa.concat_batches(held)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: An odd base: invertible modulo 2**64, so prefix sums give the hash of any stretch.
BASE = 0x9E3779B97F4A7C15 | 1
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    global _powers
    if len(_powers[0]) < n:
        m = 1 << (n - 1).bit_length()
        both = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers = (both[0], both[1])
    return _powers[0][:n], _powers[1][:n]


class Stretches:
    """64-bit content hashes of stretches of an integer array, from prefix sums.

    A polynomial modulo 2**64: stretches may overlap, but from about 1,000 symbols on there are different ones of equal hash
    (a Thue-Morse string and its complement), so it is only for shorter stretches.
    """

    def __init__(self, codes: np.ndarray):
        p, self.inverse = powers(len(codes) + 1)
        v = mix(codes.astype(np.uint64) + np.uint64(0x51ED27))
        v *= p[:-1]
        self.sums = np.empty(len(codes) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(v, out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(x + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_hashes(codes: np.ndarray, at: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of words codes[at:end] that do not overlap: each symbol is mixed with its place in the word, so no pattern of symbols cancels out."""
    n = end - at
    where = ragged(at, n)
    place = (where - np.repeat(at, n)).astype(np.uint64)
    v = mix(codes[where].astype(np.uint64) + (place + np.uint64(1 + seed)) * np.uint64(0x9E3779B97F4A7C15))
    sums = np.zeros(len(v) + 1, np.uint64)
    np.cumsum(v, out=sums[1:])
    last = np.cumsum(n)
    return mix(sums[last] - sums[last - n] + n.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def like_leader(codes: np.ndarray, at: np.ndarray, end: np.ndarray, leader: np.ndarray) -> np.ndarray:
    """Whether each word codes[at:end] is, symbol by symbol, the word number ``leader``; no word is empty."""
    n = end - at
    same = n == n[leader]
    check = np.flatnonzero(same & (leader != np.arange(len(at))))
    if len(check):
        m = n[check]
        equal = codes[ragged(at[check], m)] == codes[ragged(at[leader[check]], m)]
        same[check] = np.logical_and.reduceat(equal, np.cumsum(m) - m)
    return same


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as the long values that Spark holds."""
    return x.view(np.int64)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenation of the ranges [start, start + length)."""
    if not len(start):
        return np.zeros(0, np.int64)
    length = length.astype(np.int64)
    before = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(start.astype(np.int64) - before, length)


class WordStore:
    """The ids of words, each encoded once; emptied when it holds ``most`` words."""

    def __init__(self, encode: Callable[[str], list[int]], most: int = 1_000_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.count, self.flat = array("q"), array("q"), array("I")

    def _add(self, word: str) -> int:
        ids = self.encode(word)
        self.known[word] = k = len(self.first)
        self.first.append(len(self.flat))
        self.count.append(len(ids))
        self.flat.extend(ids)
        return k

    def _numbers(self, joined: str, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        known, add = self.known, self._add
        ks = np.empty(len(at), np.int64)
        for j, (a, b) in enumerate(zip(at.tolist(), end.tolist(), strict=True)):
            w = joined[a:b]
            k = known.get(w)
            ks[j] = add(w) if k is None else k
        return ks

    def ids(self, joined: str, codes: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each word joined[at:end], and all ids; codes are the code points of ``joined``."""
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        if len(self.known) > self.most:
            self.clear()
        _, index, inverse = np.unique(word_hashes(codes, at, end), return_index=True, return_inverse=True)
        ks = self._numbers(joined, at[index], end[index])[inverse]
        # words of one hash are one word only if their symbols are
        other = np.flatnonzero(~like_leader(codes, at, end, index[inverse]))
        ks[other] = self._numbers(joined, at[other], end[other])
        count = np.array(self.count, np.int64)[ks]
        return count, np.array(self.flat, np.uint32)[ragged(np.array(self.first, np.int64)[ks], count)]
