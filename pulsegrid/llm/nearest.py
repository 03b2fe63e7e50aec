"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

The trees are grown on a bounded sample: a node parts its points between two of them taken
at random. Every vector is dealt to one leaf a tree. A query walks all trees at once with
one priority queue, always on from the node whose cut it is furthest inside of, until it has
as many leaves as it may look at; the vectors there are ranked exactly.
"""

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.batches import Batches, map_batches
from pulsegrid.session import written

#: Sampled vectors, trees, sampled vectors a leaf holds at most, leaves a query looks at.
SAMPLE, TREES, LEAF, PROBES = 60_000, 10, 64, 640
#: Vectors of a leaf that one task ranks at a time.
BLOCK = 4096


class Tree(NamedTuple):
    """Inner node i cuts at normals[i] . x >= cuts[i]; children below 0 are leaves -1 - n."""

    normals: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    leaves: int


def grow(points: np.ndarray, rng: np.random.Generator, leaf: int) -> Tree:
    normals, cuts, children, leaves = [], [], [], 0
    root: list[list[int]] = [[0, 0]]
    stack = [(np.arange(len(points)), root[0], 0)]
    while stack:
        some, parent, side = stack.pop()
        split = None
        if len(some) > leaf:
            for _ in range(5):
                p, q = points[rng.choice(some, 2, replace=False)]
                normal = p - q
                if np.any(normal):
                    height = points[some] @ normal
                    cut = float(np.median(height))
                    high = height >= cut if (height < cut).any() else height > cut
                    if high.any() and not high.all():
                        split = normal, cut if (height < cut).any() else float(np.nextafter(cut, np.inf)), high
                        break
        if split is None:
            leaves += 1
            parent[side] = -leaves
            continue
        parent[side] = len(cuts)
        normals.append(split[0])
        cuts.append(split[1])
        children.append([0, 0])
        stack.append((some[~split[2]], children[-1], 0))
        stack.append((some[split[2]], children[-1], 1))
    size = points.shape[1]
    return Tree(np.array(normals).reshape(-1, size), np.array(cuts), np.array(children).reshape(-1, 2), leaves)


def leaves_of(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The leaf of each point, from 0 on."""
    out = np.zeros(len(points), np.int64)
    if not len(tree.cuts):
        return out
    at, open_ = np.zeros(len(points), np.int64), np.arange(len(points))
    while len(open_):
        node = at[open_]
        high = np.einsum("ij,ij->i", points[open_], tree.normals[node]) >= tree.cuts[node]
        after = tree.children[node, high.astype(int)]
        at[open_] = after
        done = after < 0
        out[open_[done]] = -1 - after[done]
        open_ = open_[~done]
    return out


def probe(forest: list[Tree], point: np.ndarray, probes: int) -> list[tuple[int, int]]:
    """The (tree, leaf) a query looks at, best first, from one queue over all trees."""
    queue = [(-np.inf, t, 0 if len(tree.cuts) else -1) for t, tree in enumerate(forest)]
    heapq.heapify(queue)
    found = []
    heights = [tree.normals @ point - tree.cuts for tree in forest]
    while queue and len(found) < probes:
        worth, t, node = heapq.heappop(queue)
        if node < 0:
            found.append((t, -1 - node))
            continue
        margin = float(heights[t][node])
        low, high = forest[t].children[node].tolist()
        heapq.heappush(queue, (max(worth, -margin), t, high))
        heapq.heappush(queue, (max(worth, margin), t, low))
    return found


def _unit(batch_vectors: list, kind: str) -> np.ndarray:
    values = np.array(batch_vectors, kind).astype(np.float64)
    return values / np.sqrt((values * values).sum(1, keepdims=True))


def nearest(
    vectors: DataFrame, k: int = 5, every: int = 50, sample: int = SAMPLE, trees: int = TREES, probes: int = PROBES,
    id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found for each row whose id is
    divisible by ``every``, among all other rows; all of them, if there are fewer.

    Score is the cosine in double precision of the vectors as they are; ties go to the
    smaller id. Rows without id, and vectors that are null, zero, of another length than
    most, or hold null or non-finite components take no part. Repeated rows count once, and
    of several vectors with one id the one with the least hash stands for it.
    Equal vectors are searched once, with their ``k`` + 1 smallest ids: no more of them can
    be in a result. Large leaves are dealt to tasks in blocks. Other columns are not looked at.
    """
    kind = {"array<float>": "<f4", "array<double>": "<f8"}[vectors.schema[vector_col].dataType.simpleString()]
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL").where(fine)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    keyed = rows.where(F.size("v") == common["d"]).select("id", F.struct(F.xxhash64("v").alias("k1"), F.hash("v").alias("k2"), "v").alias("x"))
    rows = written(keyed.groupBy("id").agg(F.min("x").alias("x")).select("id", "x.*"), "vectors")
    by_vector = Window.partitionBy("k1", "k2").orderBy("id")
    distinct = rows.withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= k + 1)
    distinct = written(
        distinct.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v")), "distinct"
    )
    asked = rows.where(F.col("id") % every == 0).select("id", "k1", "k2", "v")
    questions = asked.groupBy("k1", "k2").agg(F.first("v").alias("v"))

    taken = distinct.orderBy(F.hash("k1", F.lit(seed)), "k1").limit(sample).select("v").collect()
    points = _unit([row[0] for row in taken], kind)
    rng = np.random.default_rng(seed)
    forest = rows.sparkSession.sparkContext.broadcast([grow(points, rng, LEAF) for _ in range(trees)])

    def deal(batches: Batches) -> Batches:
        for batch in batches:
            found = batch.column("v").to_pylist()
            if not found:
                continue
            unit = _unit(found, kind)
            data = pa.array([x.tobytes() for x in np.array(found, kind)], pa.binary())
            for t, tree in enumerate(forest.value):
                yield pa.record_batch(
                    [pa.array(np.full(len(found), t), pa.int32()), pa.array(leaves_of(tree, unit), pa.int32()), batch.column("k1"), batch.column("k2"), batch.column("ids"), data],
                    ["tree", "leaf", "k1", "k2", "ids", "data"],
                )

    def ask(batches: Batches) -> Batches:
        for batch in batches:
            found = batch.column("v").to_pylist()
            if not found:
                continue
            places = [probe(forest.value, x, probes) for x in _unit(found, kind)]
            which = np.repeat(np.arange(len(found)), [len(p) for p in places])
            flat = np.array([x for p in places for x in p]).reshape(-1, 2)
            data = pa.array([x.tobytes() for x in np.array(found, kind)], pa.binary())
            yield pa.record_batch(
                [pa.array(flat[:, 0], pa.int32()), pa.array(flat[:, 1], pa.int32()), batch.column("k1").take(pa.array(which)), batch.column("k2").take(pa.array(which)), data.take(pa.array(which))],
                ["tree", "leaf", "k1", "k2", "data"],
            )

    dealt = written(map_batches(distinct, deal, "tree int, leaf int, k1 long, k2 int, ids array<long>, data binary"), "leaves")
    sizes = dealt.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = F.broadcast(sizes)  # a row for each leaf of trees grown on the sample
    entries = dealt.join(sizes, ["tree", "leaf"]).select(
        "tree", "leaf", F.pmod(F.col("k2"), F.col("blocks")).alias("block"), F.lit(0).alias("role"), "k1", "k2", "ids", "data"
    )
    probes_ = map_batches(questions, ask, "tree int, leaf int, k1 long, k2 int, data binary").join(sizes, ["tree", "leaf"]).select(
        "tree", "leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "k1", "k2",
        F.lit(None).cast("array<long>").alias("ids"), "data",
    )

    def rank(batches: Batches) -> Batches:
        place, lists, held, norms = None, [], [], None
        for batch in batches:
            out: list[tuple] = []
            for t, leaf, block, role, k1, k2, ids, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (t, leaf, block) != place:
                    place, lists, held, norms = (t, leaf, block), [], [], None
                value = np.frombuffer(data, kind).astype(np.float64)
                if role == 0:
                    lists.append(ids)
                    held.append(value)
                    continue
                if not held:
                    continue
                if norms is None:
                    matrix = np.stack(held)
                    norms = np.sqrt((matrix * matrix).sum(1))
                # a sum along each row: the same for the same vector wherever it stands
                score = (matrix * value).sum(1) / (norms * np.sqrt((value * value).sum()))
                least = np.partition(score, -(k + 1))[-(k + 1)] if len(score) > k + 1 else -np.inf
                best = sorted((-score[i], v) for i in np.flatnonzero(score >= least) for v in lists[i])[: k + 1]
                out += [(k1, k2, v, -s) for s, v in best]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.record_batch(
                [pa.array(c, x) for c, x in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["k1", "k2", "vec_id", "score"]
            )

    together = entries.unionByName(probes_).repartition("tree", "leaf", "block").sortWithinPartitions("tree", "leaf", "block", "role")
    found = map_batches(together, rank, "k1 long, k2 int, vec_id long, score double").dropDuplicates(["k1", "k2", "vec_id"])
    order = (F.desc("score"), F.asc("vec_id"))
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("k1", "k2").orderBy(*order))).where(F.col("r") <= k + 1)
    answered = asked.select(F.col("id").alias("query_id"), "k1", "k2").join(best.drop("r"), ["k1", "k2"]).where("query_id <> vec_id")
    ranked = answered.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
