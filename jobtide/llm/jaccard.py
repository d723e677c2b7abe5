"""Exact Jaccard join of shingle sets by a universe partition and the pigeonhole principle.

Sets fall into size bands. For the larger set's band, hashing deals the universe of shingles into segments. Two sets that link differ in
at most H elements, so with more than H segments some segment is equal in both; a segment that is indexed with its
one-deletion neighbourhood tolerates one difference and counts twice. How many segments are doubled is chosen for each
band by cost, measured on a sample of the documents. Sets that share a segment are candidates; parity sketches refute most of them, the rest are verified exactly.

Candidates are not all pairs of a group: each set is verified against its group's leader first, and only pairs in different
components are looked at afterwards, block by block, with the sketches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, discard, documents, groups, mix, released, scratch, signed, sliced, written
from .components import components
from .shingles import Sets, shingle_sets

SKETCH_BITS = 4096
#: Texts whose sketches are counted at once.
SKETCH_TEXTS = 128
#: Characters whose sets a task holds at once.
SET_CHARS = 250_000
#: Sets that a task knows it has indexed; beyond it the list starts anew.
SEEN_SETS = 50_000
#: Sets of a group that meet at once when the leader has not settled it.
BLOCK_SETS = 512
#: What a signature that several sets share costs against one that none does, for the choice of doubled segments.
SHARED_COST = 8.0
#: About so many documents are indexed in each way to measure the costs, and in the chosen way to find signatures that very many sets share.
#: They decide how the work is done, never what is found.
PLAN_SAMPLE, HOT_SAMPLE = 4_000, 20_000
#: A signature that so many sets of the sample share, copies that stand in different tasks included, is hot (at most HOT_SAMPLE * signatures of a set / HOT_SEEN of them); its rows are dealt to SALTS parts.
HOT_SEEN, SALTS = 20, 256


def most_apart(total: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The largest symmetric difference of two linked sets of ``total`` elements together."""
    return total - 2 * -(-percent * total // (100 + percent))


@lru_cache(8)
def bands(percent: int, most: int = 1 << 40) -> tuple[list[int], list[list[tuple[int, int, int, int]]]]:
    """Lower bounds of the size bands and, for each, its plans (H, segments, doubled segments, empty segments that do no harm), without doubled ones first."""
    lows = [1]
    while lows[-1] < most:
        lows.append(lows[-1] * 100 // percent + 1)
    every = []
    for after in lows[1:]:
        top = after - 1
        low = lows[len(every)]
        apart = 2 * (100 - percent) * top // (100 + percent)
        plans = []
        for doubled in sorted({0, apart // 4, apart // 2, (apart + 1) // 2}):
            m, spare = apart + 1 - doubled, 0
            for _ in range(60):  # room for the empty segments that a set may have
                empty = m * (1 - 1 / m) ** low if m > 1 else 0.0
                need = math.ceil(empty + 4 * empty**0.5)
                if need <= spare:
                    break
                m, spare = m + need - spare, need
            if m >= max(1, doubled):
                plans.append((apart, m, doubled, spare))
        every.append(plans)
    return lows, every


def plan_table(percent: int, choice: dict[int, int]) -> np.ndarray:
    """The plan of each band by its number in ``choice``; 0, without doubled segments, where there is none."""
    return np.array([plans[min(choice.get(k, 0), len(plans) - 1)] for k, plans in enumerate(bands(percent)[1])], np.int64)


def signatures(sets: Sets, which: np.ndarray, percent: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, signature, band) of the indexed segments of the texts ``which``, for their own band and the next, by a plan ``table``."""
    lows, plans = bands(percent)
    sizes = sets.sizes
    band = np.searchsorted(lows, sizes, side="right") - 1
    chosen = np.zeros(len(sizes), bool)
    chosen[which] = True
    texts, sigs, kinds = [], [], []
    element = mix(sets.hashes ^ np.uint64(0x3C79AC492BA7B653))
    spread = mix(sets.hashes ^ np.uint64(0x1C69B3F74AC4AE35)) >> np.uint64(32)
    for step in (0, 1):
        k = np.clip(band + step, 0, len(plans) - 1)
        apart, m, doubled, spare = table[k].T
        use = chosen & (sizes > 0) & (apart > 0)
        m = np.where(use, m, 0)
        base = np.cumsum(m) - m
        held = use[sets.owner]
        owner, el = sets.owner[held], element[held]
        segment = ((spread[held] * m[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        cell = base[owner] + segment
        total = np.zeros(int(m.sum()), np.uint64)
        np.add.at(total, cell, el)
        count = np.bincount(cell, minlength=len(total))
        text = np.repeat(np.arange(len(sizes)), m)
        place = np.arange(len(total)) - base[text]
        salt = mix(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + k[text].astype(np.uint64))
        empty = np.bincount(text, weights=count == 0, minlength=len(sizes))
        double = place < doubled[text]
        keep = (count > 0) | double | (empty > spare)[text]
        texts.append(text[keep])
        sigs.append(mix(total[keep] + salt[keep] + count[keep].astype(np.uint64)))
        one = double[cell]
        if one.any():
            c = cell[one]
            texts.append(text[c])
            sigs.append(mix(total[c] - el[one] + salt[c] + (count[c] - 1).astype(np.uint64)))
        kinds += [k[t] for t in texts[len(kinds) :]]
    return np.concatenate(texts), np.concatenate(sigs), np.concatenate(kinds)


def sketches(sets: Sets) -> np.ndarray:
    """Parities of the elements that fall on each of SKETCH_BITS bits; two sets' sketches differ in at most as many bits as the sets do in elements."""
    n, out = len(sets.sizes), []
    bit = (mix(sets.hashes ^ np.uint64(0x632BE59BD9B4E019)) >> np.uint64(40)).astype(np.int64) % SKETCH_BITS
    ends = np.concatenate([[0], np.cumsum(sets.sizes)])
    for a in range(0, n, SKETCH_TEXTS):
        b = min(n, a + SKETCH_TEXTS)
        held = slice(ends[a], ends[b])
        odd = np.bincount((sets.owner[held] - a) * SKETCH_BITS + bit[held], minlength=(b - a) * SKETCH_BITS).astype(np.uint8) & 1
        out.append(np.packbits(odd.reshape(b - a, SKETCH_BITS), axis=1))
    return np.concatenate([np.zeros((0, SKETCH_BITS // 8), np.uint8), *out])


def _fixed(column: pa.Array, kind: type) -> np.ndarray:
    """An Arrow column of equally long binaries as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _may_link(n1: np.ndarray, s1: np.ndarray, n2: np.ndarray, s2: np.ndarray, percent: int) -> np.ndarray:
    apart = np.bitwise_count(s1.view(np.uint64) ^ s2.view(np.uint64)).sum(-1)
    return (apart <= most_apart(n1 + n2, percent)) & (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2))


def row_key(docs: DataFrame) -> Column:
    """A hash of a row's id and text; null for a null id."""
    return F.when(docs["doc_id"].isNotNull(), F.xxhash64(docs["doc_id"], docs["text"]))


def describe(docs: DataFrame, words: int, keyed: bool = False) -> DataFrame:
    """(doc_id, n, sid, check, sketch) of every text and with ``keyed`` its row_key; (sid, check), the identity of the set, is null where the set is empty."""
    if keyed:
        docs = docs.select(F.struct("doc_id", row_key(docs).alias("row_key")), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches, SET_CHARS):
            s = shingle_sets(texts, words)
            sid, check = (pa.array(signed(x), mask=s.sizes == 0) for x in (s.identity, s.check))
            keys = [pa.array([i["row_key"] for i in ids], pa.int64())] if keyed else []
            ids = [i["doc_id"] for i in ids] if keyed else ids
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s.sizes.astype(np.int64)), sid, check, pa.array([r.tobytes() for r in sketches(s)], pa.binary()), *keys], names=["doc_id", "n", "sid", "check", "sketch", *["row_key"] * keyed])

    return docs.mapInArrow(run, "doc_id long, n long, sid long, check long, sketch binary" + ", row_key long" * keyed)


def index(docs: DataFrame, percent: int, words: int, tables: list[np.ndarray]) -> DataFrame:
    """(plan, band, sig, sid): the signatures of every set by each plan table; copies that a task has indexed already are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for _, texts in blocks(batches, SET_CHARS):
            s = shingle_sets(texts, words)
            if len(seen) > SEEN_SETS:
                seen.clear()
            fresh = []
            for i, x in enumerate(zip(s.identity.tolist(), s.check.tolist(), strict=True)):
                if x not in seen:
                    seen.add(x)
                    fresh.append(i)
            for plan, table in enumerate(tables):
                text, sig, band = signatures(s, np.array(fresh, np.int64), percent, table)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), plan, np.int32)), pa.array(band.astype(np.int32)), pa.array(signed(sig)), pa.array(signed(s.identity[text]))], names=["plan", "band", "sig", "sid"])

    return docs.mapInArrow(run, "plan int, band int, sig long, sid long")


def _some(docs: DataFrame, rows: int, most: int) -> DataFrame:
    """About ``most`` of ``rows`` documents, by a hash."""
    return docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, rows // most))) == 0)


def measured_plans(docs: DataFrame, rows: int, percent: int, words: int) -> np.ndarray:
    """The plan of each band that costs least: its signatures, and SHARED_COST more for each that another set shares.

    Measured on about PLAN_SAMPLE documents, by a hash. There sharing by near copies, which no plan avoids, shows in all plans alike, and sharing by chance
    shows where segments are so short or frequent that it is common. The driver gets one row for each band and plan.
    """
    tables = [plan_table(percent, {k: j for k in range(len(bands(percent)[0]))}) for j in range(max(map(len, bands(percent)[1])))]
    found = index(_some(docs, rows, PLAN_SAMPLE), percent, words, tables).groupBy("plan", "band", "sig").agg(F.count("*").alias("n"), (F.min("sid") != F.max("sid")).alias("shared"))
    cost: dict[int, dict[int, float]] = {}
    with released(docs.sparkSession):
        measured = found.groupBy("band", "plan").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("shared"), F.col("n")).otherwise(0)).alias("shared")).collect()
    for r in measured:
        cost.setdefault(r["band"], {})[r["plan"]] = r["n"] + SHARED_COST * r["shared"]
    return plan_table(percent, {k: min(c, key=lambda j: (c[j], j)) for k, c in cost.items()})


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, words: int) -> DataFrame:
    """Those pairs (a, b) of classes whose sets link, from the whole texts of one document each."""
    spark = docs.sparkSession
    paths = [scratch(spark) for _ in range(3)]
    pairs = written(pairs, paths[0])
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = written(ends.join(classes, "node").select(F.col("rep").alias("doc_id"), F.struct("node", "sid", "check").alias("class")), paths[1])
    picked = docs.join(wanted, "doc_id").select("class", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches, SET_CHARS):
            s = shingle_sets(texts, words)
            sizes = np.cumsum(s.sizes)
            # ids that more than one row has may bring a text of another set
            halves = zip(signed(s.identity).tolist(), signed(s.check).tolist(), strict=True)
            right = [k for k, h in enumerate(halves) if h == (ids[k]["sid"], ids[k]["check"])]
            values = [s.hashes[sizes[k] - s.sizes[k] : sizes[k]].tobytes() for k in right]
            yield pa.RecordBatch.from_arrays([pa.array([ids[k]["node"] for k in right], pa.int64()), pa.array(values, pa.binary())], names=["node", "members"])

    sets = written(picked.mapInArrow(run, "node long, members binary").dropDuplicates(["node"]), paths[2])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(u) + len(v) - len(np.union1d(u, v))
                keep.append(100 * common >= percent * (len(u) + len(v) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    links = written(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"))
    discard(spark, *paths)
    return links


def jaccard_components(docs: DataFrame, percent: int = 85, words: int = 4, keyed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each input row.

    Two documents link when 100 * intersection >= percent * union of their sets of distinct ``words``-word shingles. A
    null or empty text, or one without words, has no shingles and links with nothing. component_id is the smallest id reachable by links, itself
    included; rows of equal ids and different sets may differ in it, a null id stays null. ``keyed`` adds the row_key.

    Sets are told apart by 128 bits. Within a pair shingles are compared by 64 bits, each word's hash mixing every symbol with its place: two sets of 1,000
    shingles err with a chance of about 1e-13.
    """
    docs = documents(docs)
    spark = docs.sparkSession
    described = written(describe(docs, words, keyed))
    rows = described.count()
    kinds = described.where("sid is not null and doc_id is not null").groupBy("sid", "check").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(kinds.withColumn("node", F.monotonically_increasing_id()))

    table = measured_plans(docs, rows, percent, words)
    often = index(_some(docs, rows, HOT_SAMPLE), percent, words, [table]).groupBy("sig").agg(F.count("*").alias("sets"), F.min("sid").alias("low"), F.max("sid").alias("high")).where((F.col("sets") >= HOT_SEEN) & (F.col("low") != F.col("high")))
    hot = written(often.select("sig", F.lit(True).alias("hot")))
    # rows of a hot signature, which several sets are known to share, are dealt to several parts
    found = index(docs, percent, words, [table]).select("sig", "sid").join(F.broadcast(hot), "sig", "left")
    found = found.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("sid"), F.lit(SALTS))).otherwise(0))
    part = Window.partitionBy("sig", "salt")
    found = found.withColumns({"low": F.min("sid").over(part), "high": F.max("sid").over(part), "size": F.count("*").over(part)})
    shared = written(found.where(F.col("hot").isNotNull() | (F.col("low") != F.col("high"))).select("sig", "sid", "size").distinct())
    # the leader of a group is the set that shares most with others: of near copies the one that they were made from
    weight = shared.groupBy("sid").agg(F.sum("size").alias("weight"))
    lead = written(shared.join(weight, "sid").groupBy("sig").agg(F.max(F.struct("weight", "sid"))["sid"].alias("lead")))

    def refute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2048):
            if b.num_rows:
                n1, n2 = (b.column(i).to_numpy() for i in (3, 5))
                yield b.select(["a", "b", "common"]).filter(pa.array(_may_link(n1, _fixed(b.column(4), np.uint8), n2, _fixed(b.column(6), np.uint8), percent)))

    pairs = shared.join(lead, "sig").where("sid != lead").groupBy(F.col("sid").alias("sid_a"), F.col("lead").alias("sid_b")).agg(F.count("*").alias("common"))
    one, two = (classes.select(F.col("sid").alias(f"sid_{c}"), F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
    likely = pairs.join(one, "sid_a").join(two, "sid_b").select("a", "b", "common", "n_a", "sketch_a", "n_b", "sketch_b").mapInArrow(refute, "a long, b long, common long")
    first = likely.groupBy("a").agg(F.max_by("b", F.struct("common", "b")).alias("b"))
    links = _verified(first, docs, classes, percent, words)

    label = components(links)
    named = classes.select("sid", "node").join(label, "node", "left").select(F.col("sid").alias("half"), F.col("node").alias("sid"), F.coalesce("component", "node").alias("component"))
    placed_path, group_path = scratch(spark), scratch(spark)
    placed = written(shared.join(named, shared["sid"] == named["half"]).select("sig", named["sid"], "component"), placed_path)
    parted = placed.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("sid")).alias("members")).where("low != high")
    # groups of the same members are looked at once
    parted = written(parted.groupBy("members", "size").agg(F.min("sig").alias("sig")).select("sig", "size"), group_path)
    open_ = placed.join(parted, "sig")
    nb = F.ceil(F.col("size") / BLOCK_SETS).cast("int")
    open_ = open_.withColumn("own", F.pmod(F.xxhash64("sid"), nb).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), nb - 1)))
    open_ = open_.select("sig", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "sid", "component")
    open_ = open_.join(classes.select(F.col("node").alias("sid"), "n", "sketch"), "sid")
    ordered = open_.select("sig", "x", "y", "own", "sid", "component", "n", "sketch").repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of a block of a group that are in different components and that the sketches don't refute."""

        for _, t in groups(batches, 3):
            x, y, own, sid, comp, n = (t.column(i).to_numpy() for i in (1, 2, 3, 4, 5, 6))
            sketch = _fixed(t.column(7), np.uint8)
            left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in left:
                js = right[(comp[right] != comp[i]) & ((sid[right] > sid[i]) | (x[0] != y[0]))]
                js = js[_may_link(n[js], sketch[js], n[i], sketch[i], percent)] if len(js) else js
                a.append(np.full(len(js), sid[i]))
                b.append(sid[js])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    # different sets whose first halves agree have not met yet
    halves = classes.join(classes.groupBy("sid").count().where("count > 1"), "sid", "left_semi").select("sid", "node")
    twins = halves.withColumnRenamed("node", "a").join(halves.withColumnRenamed("node", "b"), "sid").where("a < b").select("a", "b")
    rest = ordered.mapInArrow(across, "a long, b long").unionByName(twins).distinct()
    more = _verified(rest, docs, classes, percent, words)
    discard(spark, placed_path, group_path)

    label = components(links.unionByName(more))
    joined = classes.select("sid", "check", "node", "rep").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = joined.join(smallest, "component").select("sid", "check", "component_id")
    out = described.select("doc_id", F.col("n").alias("n_shingles"), "sid", "check", *["row_key"] * keyed).join(ids, ["sid", "check"], "left")
    # links are between sets, so rows that share an id share a component only where their sets do
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), *["row_key"] * keyed)
