"""Near-duplicate embeddings by a forest of random-projection trees.

Each tree splits recursively by random directions at the median. Vectors within a margin of the threshold go to both
sides (spill), so that a close pair is seldom parted in a tree and almost never in all. The upper levels are fitted on a bounded sample of all
vectors; leaves that are too large for it are split further, each on a bounded sample of its own, until they fit. Vectors are compared within leaves only, in
double precision near the threshold, and joined to components.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, groups, made, runs, scratch, written
from .components import components
from .vectors import matrix, sampled, usable

THRESHOLD = 0.95
#: The trees are fitted on so many vectors at most; every vector is indexed.
SAMPLE = 16_384
TREES, LEAF_ROWS = 5, 160
#: Leaves of more than SPLIT times LEAF_ROWS vectors are split again, on about LEAF_SAMPLE of their own vectors; a task splits PART_ROWS of a leaf's rows.
SPLIT, LEAF_SAMPLE, PART_ROWS = 4, 2048, 100_000
#: Rounds of splitting, each of up to about a hundred parts; leaves that are too large even then are compared block by block.
ROUNDS = 4
#: More than the leaves of the upper levels; each round's leaves have numbers of their own.
FIRST_LEAVES = 1 << 20
#: A margin in units of the spread that a random direction sees between a pair at the threshold.
MARGIN = 0.45
#: Rows of a leaf that meet at once; a larger leaf is compared block by block.
BLOCK_ROWS = 4096


class Tree:
    """Inner nodes as (direction, threshold, left, right); a negative child -k is leaf number k - 1."""

    def __init__(self, sample: np.ndarray, rows: int, rng: np.random.Generator, first_leaf: int, theta: float, leaf_rows: int):
        self.dim, self.nodes, self.leaves = sample.shape[1], [], first_leaf
        self.margin = MARGIN * np.sqrt((2 - 2 * theta) / self.dim)
        self.small = max(8.0, leaf_rows * len(sample) / max(rows, 1))
        self.rng = rng
        self.root = self._grow(sample, 0)

    def _grow(self, x: np.ndarray, depth: int) -> int:
        if len(x) > self.small and depth < 40:
            for _ in range(3):
                direction = self.rng.standard_normal(self.dim)
                direction /= np.linalg.norm(direction)
                p = x @ direction
                cut = float(np.median(p))
                left, right = p < cut + self.margin, p >= cut - self.margin
                if max(left.sum(), right.sum()) <= 0.85 * len(x):  # else the node is too tight to split
                    at = len(self.nodes)
                    self.nodes.append(None)
                    self.nodes[at] = (direction, cut, self._grow(x[left], depth + 1), self._grow(x[right], depth + 1))
                    return at
        self.leaves += 1
        return -self.leaves

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a row falls into."""
        rows, leaves, todo = [], [], [(self.root, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                leaves.append(np.full(len(at), -node - 1))
                continue
            direction, cut, left, right = self.nodes[node]
            p = x[at] @ direction
            todo += [(left, at[p < cut + self.margin]), (right, at[p >= cut - self.margin])]
        return np.concatenate(rows), np.concatenate(leaves)


def grow(sample: np.ndarray, rows: int, theta: float = THRESHOLD, trees: int = TREES, leaf_rows: int = LEAF_ROWS) -> list[Tree]:
    forest, first, rng = [], 0, np.random.default_rng(3)
    for _ in range(trees):
        forest.append(Tree(sample, rows, rng, first, theta, leaf_rows))
        first = forest[-1].leaves
    return forest


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked(a: np.ndarray, b: np.ndarray, theta: float) -> np.ndarray:
    """Which pairs of unit vectors have a cosine of at least theta: single precision first, double near the threshold."""
    s = a.astype(np.float32) @ b.astype(np.float32).T
    out = s >= theta
    i, j = np.nonzero(np.abs(s - np.float32(theta)) < 1e-4)
    out[i, j] = np.einsum("ij,ij->i", a[i], b[j]) >= theta
    return out


def _labels(mask: np.ndarray) -> np.ndarray:
    """Component numbers of a symmetric link matrix."""
    label = np.full(len(mask), -1)
    for s in range(len(mask)):
        if label[s] < 0:
            front = np.array([s])
            while len(front):
                label[front] = s
                front = np.flatnonzero(mask[front].any(0) & (label < 0))
    return label


def _lists(row: np.ndarray, leaf: np.ndarray, n: int) -> pa.Array:
    """The sorted leaves of each of n rows."""
    order = np.lexsort((leaf, row))
    ends = np.cumsum(np.bincount(row, minlength=n))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(leaf[order].astype(np.int64)))


def _split(routed: DataFrame, theta: float, leaf_rows: int) -> DataFrame:
    """``routed`` with the leaves of more than SPLIT * ``leaf_rows`` vectors split again; a leaf too tight to split gets a negative number and stays."""
    spark, dim = routed.sparkSession, routed.schema["embedding"].dataType.simpleString()

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        leaf, n = int(g["leaf"].iloc[0]), int(g["n"].iloc[0])
        x = _unit(np.stack(g["embedding"].to_numpy()).astype(np.float64))
        tree = Tree(x, n, np.random.default_rng(leaf), 0, theta, leaf_rows)
        return pd.DataFrame({"leaf": [leaf], "tree": [pickle.dumps(tree)]})

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part of a leaf: its tree comes first, then its rows pass."""
        tree = None
        for (leaf, _, turn), b in runs(batches, 3):
            if turn == 0:
                tree = pickle.loads(b.column(5)[0].as_py())
                continue
            row, child = tree.route(_unit(matrix(b.column(4))))
            child = (leaf + FIRST_LEAVES) * 1024 + child if tree.leaves > 1 else np.full(len(row), -leaf - 1)
            yield pa.RecordBatch.from_arrays([b.column(3).take(pa.array(row)), pa.array(child.astype(np.int64))], names=["vec_id", "leaf"])

    for _ in range(ROUNDS):
        placed = routed.select("vec_id", "embedding", F.explode("leaves").alias("leaf"))
        paths = [scratch(spark) for _ in range(3)]
        large = written(placed.groupBy("leaf").agg(F.count("*").alias("n")).where((F.col("n") > SPLIT * leaf_rows) & (F.col("leaf") >= 0)), paths[0])
        if not large.limit(1).count():
            discard(spark, paths[0])
            return routed
        share = F.pmod(F.xxhash64("vec_id", "leaf"), F.ceil(F.col("n") / LEAF_SAMPLE))
        trees = written(placed.join(large, "leaf").where(share == 0).select("leaf", "n", "embedding").groupBy("leaf").applyInPandas(fit, "leaf long, tree binary"), paths[1])
        parts = F.ceil(F.col("n") / PART_ROWS).cast("int")
        head = trees.join(large, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("turn"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast(dim).alias("embedding"), "tree")
        body = placed.join(large, "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("part"), F.lit(1).alias("turn"), "vec_id", "embedding", F.lit(None).cast("binary").alias("tree"))
        moved = written(head.unionByName(body).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "turn").mapInArrow(route, "vec_id long, leaf long"), paths[2])
        stayed = placed.select("vec_id", "leaf").join(large, "leaf", "left_anti").select("vec_id", "leaf")
        leaves = stayed.unionByName(moved).groupBy("vec_id").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))
        routed = written(routed.drop("leaves").join(leaves, "vec_id"))
        discard(spark, *paths)
    return routed


def near_duplicates(vectors: DataFrame, theta: float = THRESHOLD, sample: int = SAMPLE, trees: int = TREES, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each input row.

    Links are those pairs with a cosine of at least ``theta`` that share a leaf of some tree. Vectors that are null, zero,
    of another length than most, or hold null or non-finite components have no links and are their own component. Equal
    vectors are compared once and counted as often as they occur. Null ids are their own, null, component. An empty table gives no rows.
    """
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = usable(base).where(F.exists("embedding", lambda x: x != 0))
    keyed = good.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    classes = written(keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")))
    n = classes.count()
    forest = grow(_unit(sampled(classes, "embedding", sample)), n, theta, trees, leaf_rows) if n else []
    members = keyed.select("vec_id", "h1", "h2")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(matrix(batch.column(2)))
            row, leaf = map(np.concatenate, zip(*[t.route(x) for t in forest], strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), _lists(row, leaf, len(x))], names=["vec_id", "copies", "embedding", "leaves"])

    # the driver's vectors are single precision: they are sent as such and made double again
    single = classes.select("vec_id", "copies", F.col("embedding").cast("array<float>").alias("embedding"))
    exact = classes.where(F.exists("embedding", lambda x: x != x.cast("float").cast("double"))).limit(1).count() == 0
    rows = single if exact else classes.select("vec_id", "copies", "embedding")
    kind = "float" if exact else "double"
    path, before = scratch(vectors.sparkSession), made()
    routed = _split(written(rows.mapInArrow(route, f"vec_id long, copies long, embedding array<{kind}>, leaves array<long>")), theta, leaf_rows)

    placed = routed.select("*", F.explode("leaves").alias("leaf"))
    blocks = routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")).where("blocks > 1")
    placed = placed.join(blocks, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("leaf", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "vec_id", "copies", "embedding", "leaves")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (leaf, x, y), g in groups(batches, 3):
            own, ids, copies = (g.column(i).to_numpy() for i in (3, 4, 5))
            unit = _unit(matrix(g.column(6)))
            left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
            near = linked(unit[left], unit[right], theta)
            some = np.unique(np.concatenate([left[near.any(1)], right[near.any(0)]]))
            place = np.full(len(ids), -1)
            place[some] = np.arange(len(some))
            mask = np.zeros((len(some), len(some)), bool)
            mask[np.ix_(place[left[near.any(1)]], place[right[near.any(0)]])] = near[np.ix_(near.any(1), near.any(0))]
            mask |= mask.T
            np.fill_diagonal(mask, False)
            linking = mask.any(1)
            mask, some = mask[np.ix_(linking, linking)], some[linking]
            if not len(some):
                continue
            ids, copies = ids[some], copies[some]
            root = pd.Series(ids).groupby(_labels(mask)).transform("min").to_numpy()
            # a pair counts in the first of its common leaves only
            lists = g.column(7).take(pa.array(some))
            row, earlier = np.repeat(np.arange(len(some)), pa.compute.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()
            row, earlier = row[earlier < leaf], earlier[earlier < leaf]
            if len(row):
                _, column = np.unique(earlier, return_inverse=True)
                held = np.zeros((len(some), column.max() + 1), np.float32)
                held[row, column] = 1
                mask = mask & (held @ held.T == 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(mask @ copies), pa.array(root)], names=["vec_id", "links", "root"])

    found = written(placed.repartition("leaf", "x", "y").sortWithinPartitions("leaf", "x", "y").mapInArrow(compare, "vec_id long, links long, root long"), path)
    discard(vectors.sparkSession, *[p for p in made() if p not in before])
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    told = classes.join(links, "vec_id", "left").join(joined.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    told = told.select("h1", "h2", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    per_row = members.join(told, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    per_id = per_row.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = base.select("vec_id").join(per_id, "vec_id", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(True)).alias("kept"))
