"""Approximate nearest neighbours by a forest of random-projection trees.

Trees split a bounded sample at medians of random projections; every vector is then filed in one leaf
of each tree. A query goes down all trees from one shared priority queue of nodes, likeliest first, and takes
the leaves it comes to until they hold enough vectors, and what the leaves hold is reranked by exact distance, each candidate once
however many trees gave it. Equal vectors, which no plane can part, are one vector in trees, leaves and
searches, and become their ids again after reranking; a few of most copies are candidates of every query.
Vectors and queries meet in blocks of bounded size.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenrow.llm.common import cut, join_hot, table

#: Trees are fitted to at most so many vectors, first by a hash of their ids; all vectors are filed.
MAX_SAMPLE = 32_768
TREES = 8
#: Vectors a leaf, and the least of the sample's vectors in one: beyond 8 times the sample a leaf is a fixed share of all vectors,
#: in parts of at most a block.
LEAF, LEAST_LEAF = 16, 2
#: A query takes leaves until they hold SEARCH_FACTOR * n ** SEARCH_POWER of the n vectors, counted in each tree, and at least
#: LEAST_SEARCHED: set on vectors of 64 near-independent components, where recall stays above 0.93 from 500 to
#: 600,000 of them while the share that is reranked falls from 0.7 to 0.16.
SEARCH_FACTOR, SEARCH_POWER = 5.0, 0.75
LEAST_SEARCHED = 640
#: Width of the logistic that says how likely a neighbour is beyond a plane, in standard deviations of a component.
SPREAD = 1.3
#: The queue is emptied in buckets of so much of that likelihood's negative log.
BUCKET = 0.5
#: So many vectors, those of most copies, are candidates of every query: each stands for many possible neighbours.
ALWAYS = 256
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 4_096
SEARCHES_A_TASK = 64
#: Keys of queries, 34 bytes each, that are broadcast to pick their vectors; more are joined by shuffle.
BROADCAST_KEYS = 200_000
K = 10


@dataclass
class Tree:
    """Node i splits by ``planes[i] . x >= offsets[i]`` into ``kids[i]``; a negative kid is the leaf -kid - 1."""

    planes: np.ndarray
    offsets: np.ndarray
    kids: np.ndarray

    @property
    def n_leaves(self) -> int:
        return len(self.planes) + 1

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``x``."""
        at = np.zeros(len(x), np.int64)
        going = np.arange(len(x)) if len(self.planes) else np.empty(0, np.int64)
        while len(going):
            node = at[going]
            side = (np.einsum("ij,ij->i", self.planes[node], x[going]) >= self.offsets[node]).astype(np.int64)
            at[going] = self.kids[node, side]
            going = going[at[going] >= 0]
        return -at - 1 if len(self.planes) else at


def grow(x: np.ndarray, rng: np.random.Generator, leaf: int = LEAF) -> Tree:
    """A tree over the rows of ``x``; rows that no projection parts stay in one leaf."""
    planes, offsets, kids, n_leaves = [], [], [], 0

    def build(rows: np.ndarray) -> int:
        nonlocal n_leaves
        if len(rows) > leaf:
            for _ in range(3):
                a, b = x[rng.choice(rows, 2, replace=False)]
                plane = a - b if (a != b).any() else rng.standard_normal(x.shape[1])
                norm = np.linalg.norm(plane)
                if not norm:
                    continue
                plane = plane / norm
                along = x[rows] @ plane
                middle = float(np.median(along))
                right = along >= middle
                if right.all():
                    above = along[along > middle]
                    if not len(above):
                        continue
                    middle = float(above.min())
                    right = along >= middle
                me = len(planes)
                planes.append(plane)
                offsets.append(middle)
                kids.append([0, 0])
                kids[me][0] = build(rows[~right])
                kids[me][1] = build(rows[right])
                return me
        n_leaves += 1
        return -n_leaves

    build(np.arange(len(x)))
    width = x.shape[1] if x.ndim == 2 else 0
    return Tree(np.array(planes, float).reshape(-1, width), np.array(offsets, float), np.array(kids, np.int64).reshape(-1, 2))


@dataclass
class Forest:
    trees: list[Tree]
    #: Vectors filed in each leaf of each tree.
    sizes: list[np.ndarray]
    spread: float

    @property
    def first(self) -> np.ndarray:
        """What is added to a leaf's number in its tree to number the leaves of all trees."""
        return np.concatenate([[0], np.cumsum([tree.n_leaves for tree in self.trees])])

    @functools.cached_property
    def nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Planes, offsets and kids of all trees, their roots and their leaves' sizes; nodes and leaves are numbered over all trees, leaf i as -i - 1."""
        before, kids, roots = 0, [], []
        for tree, leaf in zip(self.trees, self.first, strict=False):
            roots.append(before if len(tree.planes) else -leaf - 1)
            kids.append(np.where(tree.kids < 0, tree.kids - leaf, tree.kids + before))
            before += len(tree.planes)
        return np.concatenate([t.planes for t in self.trees]), np.concatenate([t.offsets for t in self.trees]), np.concatenate(kids), np.array(roots), np.concatenate(self.sizes)

    def search(self, q: np.ndarray, enough: int) -> tuple[np.ndarray, int]:
        """The leaves, numbered over all trees, that a query takes, and how many planes it was held against.

        One queue over all trees holds nodes and leaves by how unlikely they hold a neighbour of ``q``: the sum
        along their path of the negative log of a logistic of the margin in ``spread``. It is emptied in
        buckets of BUCKET, likeliest first, in which nodes give way to their kids, until the leaves in
        it hold enough; the likeliest of these are taken. Only planes on the way to them are looked at.
        """
        planes, offsets, kids, roots, sizes = self.nodes
        at, cost, top, met = roots, np.zeros(len(roots)), 0.0, 0
        leaves, leaf_cost, held = [roots[:0]], [cost[:0]], 0
        while len(at) and held < enough:
            top = max(top, float(cost.min())) + BUCKET
            while (now := cost <= top).any():
                going, paid, at, cost = at[now], cost[now], at[~now], cost[~now]
                ends = going < 0
                leaves.append(-going[ends] - 1)
                leaf_cost.append(paid[ends])
                held += int(sizes[leaves[-1]].sum())
                going, paid = going[~ends], paid[~ends]
                margin = (planes[going] @ q - offsets[going]) / self.spread
                met += len(going)
                at = np.concatenate([at, kids[going].ravel()])
                cost = np.concatenate([cost, (paid[:, None] + np.logaddexp(0, np.stack([margin, -margin], 1))).ravel()])
        found, paid = np.concatenate(leaves), np.concatenate(leaf_cost)
        found = found[np.argsort(paid, kind="stable")]
        found = found[sizes[found] > 0]
        filled = np.cumsum(sizes[found])
        return found[: int(np.searchsorted(filled, enough)) + 1], met


def usable(vector: Column) -> Column:
    """Whether a vector is not all zero and without null or non-finite components."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return ~bad & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def filed(vectors: DataFrame, trees: list[Tree], width: int) -> DataFrame:
    """(vec_id, embedding, leaves): the leaf of each tree for each vector."""

    @F.arrow_udf("array<int>")
    def leaves(embedding: pa.Array) -> pa.Array:
        x = _matrix(embedding, width)
        found = np.stack([tree.leaves(x) for tree in trees], 1).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, len(trees)), pa.int32()), pa.array(found.ravel()))

    return vectors.withColumn("leaves", leaves("embedding"))


FOUND = pa.schema([("asked", pa.string()), ("vec_id", pa.int64()), ("score", pa.float64())])


def rerank(forest: Forest, width: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of a block of queries (asked, query, taken) and one of vectors (ids, embedding, leaves): the nearest candidates.

    A query's candidates are the block's vectors that lie in any leaf it takes, and those marked
    ``always``; the ids of the k + 1 nearest are given.
    """
    first = forest.first

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {name: [] for name in FOUND.names}
        if left.num_rows and right.num_rows:
            ids = right["ids"].to_pylist()
            order = np.argsort([each[0] for each in ids], kind="stable")
            y = _matrix(right["embedding"].combine_chunks(), width)[order]
            leaves = (_matrix(right["leaves"].combine_chunks(), len(forest.trees)).astype(np.int64)[order] + first[:-1]).ravel()
            rows, ends = np.argsort(leaves, kind="stable") // len(forest.trees), np.cumsum(np.bincount(leaves, minlength=int(first[-1])))
            starts = ends - np.diff(ends, prepend=0)
            always = np.array(right["always"].to_pylist(), bool)[order]
            for asked, taken, q in zip(left["asked"].to_pylist(), left["taken"].to_pylist(), _matrix(left["query"].combine_chunks(), width), strict=True):
                taken = np.frombuffer(taken, "<i4")
                sizes, here = ends[taken] - starts[taken], always.copy()
                here[rows[np.repeat(starts[taken] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]] = True
                at = np.flatnonzero(here)
                score = np.sqrt(((y[at] - q) ** 2).sum(1))
                for i in np.argsort(score, kind="stable")[: k + 1]:
                    out["vec_id"] += ids[order[at[i]]]
                    out["score"] += [score[i]] * len(ids[order[at[i]]])
                    out["asked"] += [asked] * len(ids[order[at[i]]])
        return pa.table(out, FOUND)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = K, **options: object) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found to each query by Euclidean distance.

    Ties go to the smaller vec_id. Null ids, and vectors that are null, zero or hold null or
    non-finite components, take no part. Vectors of one width are searched among themselves, one
    forest a width. Rows that repeat an id and vector are one; the rows of an id with several
    vectors are all searched and all searched for, and the id is as near as the nearest of them.
    Other columns are left out; an empty table gives no rows. ``options`` are those of
    :func:`search_width`.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("asks")).filter("vec_id is not null and size(embedding) > 0")
    key = F.concat(F.hex(F.xxhash64("embedding")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "embedding")))
    rows = cut(rows.filter(usable(F.col("embedding"))).groupBy("vec_id", "embedding").agg(F.max("asks").alias("asks")).withColumn("key", key))
    widths = [r[0] for r in rows.select(F.size("embedding")).distinct().orderBy(F.size("embedding")).collect()] or [1]
    found = [search_width(rows.filter(F.size("embedding") == width), width, k, **options) for width in widths]
    best = functools.reduce(DataFrame.unionByName, found).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_width(rows: DataFrame, width: int, k: int = K, trees: int = TREES, leaf: int = LEAF, factor: float = SEARCH_FACTOR, least: int = LEAST_SEARCHED, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """(query_id, vec_id, score) with at least the k nearest ids found to each row that asks.

    ``rows`` (vec_id, embedding, asks, key) are computed and distinct; equal vectors have one key.
    Every vector is a candidate where all of them in all trees are no more than ``least``.
    """
    spark = rows.sparkSession
    copies = rows.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    most = [r["key"] for r in rows.groupBy("key").count().filter("count > 1").orderBy(F.desc("count"), "key").limit(ALWAYS).collect()]
    distinct = copies.groupBy("key", "embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    distinct = cut(distinct.withColumn("always", F.col("key").isin(most)))
    queries = cut(rows.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("key").alias("asked")))
    total = distinct.count()
    sample = distinct.select("embedding", "key").orderBy("key").limit(max_sample).select("embedding").toArrow()
    x = _matrix(sample["embedding"].combine_chunks(), width) if total else np.empty((0, width))
    rng = np.random.default_rng(5)
    grown = [grow(x, rng, max(LEAST_LEAF, leaf * len(x) // max(1, total))) for _ in range(trees)]
    index = cut(filed(distinct, grown, width))
    sizes = [np.zeros(tree.n_leaves, np.int64) for tree in grown]
    filled = index.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").agg(F.count("*").alias("n")).toArrow()
    for t in range(trees):
        mine = filled.filter(pc.equal(filled["tree"], t))
        sizes[t][mine["leaf"].to_numpy()] = mine["n"].to_numpy()
    spread = SPREAD * (float(np.sqrt(x.var(0).mean())) if total else 0.0)
    forest = Forest(grown, sizes, spread if spread > 0 else 1.0)
    enough = max(least, int(factor * total**SEARCH_POWER))

    @F.arrow_udf("binary")
    def probes(embedding: pa.Array) -> pa.Array:
        return pa.array([forest.search(q, enough)[0].astype("<i4").tobytes() for q in _matrix(embedding, width)], pa.binary())

    wanted = cut(queries.select(F.col("asked").alias("key")).distinct())
    searched = cut(index.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted, "key", "left_semi"))
    n_asked = searched.count()
    blocks, groups = max(1, -(-total // BLOCK_ROWS)), max(1, -(-n_asked // BLOCK_QUERIES))
    part = lambda n: F.pmod(F.xxhash64("key", F.lit(3)), F.lit(n)).cast("int")
    asked = cut(searched.repartition(max(1, n_asked // SEARCHES_A_TASK), "key").select("key", F.col("embedding").alias("query"), probes("embedding").alias("taken")))
    asked = asked.select(F.col("key").alias("asked"), "query", "taken", part(groups).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    stock = index.select("ids", "embedding", "leaves", "always", part(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    near = asked.groupBy("block", "group").cogroup(stock.groupBy("block", "group")).applyInArrow(rerank(forest, width, k), "asked string, vec_id long, score double")
    ranks = Window.partitionBy("asked").orderBy("score", "vec_id")
    near = cut(near.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k + 1).drop("rank"))
    places = near.groupBy("asked").agg(F.collect_list(F.struct("vec_id", "score")).alias("near"))
    each = join_hot(queries, places, "asked").select("query_id", F.explode("near").alias("at"))
    return each.select("query_id", F.col("at.vec_id").alias("vec_id"), F.col("at.score").alias("score")).filter("query_id <> vec_id")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract result: the ten nearest to every vector whose id is divisible by 100, among all others."""
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
