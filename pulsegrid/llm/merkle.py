"""A Merkle manifest of a table, and proofs of its rows by octopus multiproofs.

Rows are leaves; each value of a grouping column has a tree of its own, and the roots of
these trees are the leaves of one more. Every FAN consecutive nodes have one parent.
Leaves are kept in aligned blocks. A block works out which nodes outside it its leaves need
for their roots, each named once however many leaves need it, fetches these in one join,
derives the interior nodes its leaves share, and expands the proof of every leaf by itself.
"""

from collections.abc import Iterable
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.batches import Batches, map_batches
from pulsegrid.operators.joins import keys_fit_broadcast
from pulsegrid.session import written

#: Children of a node; levels of a block, which thus has FAN ** LEVELS leaves at most.
FAN, LEVELS = 8, 4
#: What a leaf is made of.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the roots of the others. Theirs are "n" for null and "v" before a value.
TOP = ""


def digest(parts: Iterable[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(total: int) -> int:
    """Level of the root over so many leaves."""
    level = 0
    while total > 1:
        total, level = -(-total // FAN), level + 1
    return level


def width(total: int, level: int) -> int:
    """Nodes of a level."""
    for _ in range(level):
        total = -(-total // FAN)
    return total


def missing(places: Iterable[int], total: int) -> list[tuple[int, int]]:
    """The fewest nodes (level, index) that together with the leaves at ``places`` give the
    root of ``total`` leaves: the others of every run that holds a leaf or a derived node."""
    out: list[tuple[int, int]] = []
    known, level = set(places), 0
    while total > 1:
        parents = {i // FAN for i in known}
        for p in sorted(parents):
            out += [(level, i) for i in range(p * FAN, min(total, (p + 1) * FAN)) if i not in known]
        known, level, total = parents, level + 1, -(-total // FAN)
    return out


def derive(nodes: dict[tuple[int, int], str], total: int) -> dict[tuple[int, int], str]:
    """``nodes`` with all parents whose children are all there, level by level."""
    full = dict(nodes)
    for level in range(height(total)):
        wide = width(total, level)
        for p in sorted({i // FAN for at, i in full if at == level}):
            run = [full.get((level, i)) for i in range(p * FAN, min(wide, (p + 1) * FAN))]
            if None not in run:
                full[level + 1, p] = digest(run)
    return full


class Paths:
    """Proofs in one tree whose needed nodes are known; what leaves share is made once."""

    def __init__(self, nodes: dict[tuple[int, int], str], total: int):
        self.nodes, self.total, self.height = nodes, total, height(total)
        self.wide = [width(total, level) for level in range(self.height + 1)]
        self.above: dict[tuple[int, int], bytes] = {}

    def _run(self, level: int, i: int) -> range:
        first = i - i % FAN
        return range(first, min(self.wide[level], first + FAN))

    def siblings(self, i: int, level: int = 0) -> bytes:
        """Siblings from a node up to the root, left to right, 32 bytes each."""
        if level == self.height:
            return b""
        here = bytes.fromhex("".join(self.nodes[level, j] for j in self._run(level, i) if j != i))
        parent = (level + 1, i // FAN)
        if parent not in self.above:
            self.above[parent] = self.siblings(parent[1], parent[0])
        return here + self.above[parent]

    def fold(self, i: int, leaf: str) -> str:
        """The root that follows from ``leaf`` at place ``i`` and its siblings."""
        for level in range(self.height):
            leaf = digest(leaf if j == i else self.nodes[level, j] for j in self._run(level, i))
            i //= FAN
        return leaf


class Manifest(NamedTuple):
    """``blocks``: tree, total, block, leaves (array of place, doc_id, leaf, claim).
    ``nodes``: tree, total, level, idx, hash, is_root: of the trees all nodes from the
    blocks' roots up, of the top tree all. ``trees``: tree, place and trees (their number), of
    the trees in the top one. Digests are 32 bytes."""

    blocks: DataFrame
    nodes: DataFrame
    trees: DataFrame
    levels: int


def leaf_digest(columns: dict[str, Column]) -> Column:
    """Digest of the fields: ``-`` for null, else the UTF-8 length, a colon, the value."""
    parts = []
    for value in columns.values():
        value = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def write_manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id",
    claims: dict[str, Column] | None = None, claimed: Column | None = None, levels: int = LEVELS,
) -> Manifest:
    """The manifest of ``docs``, in tables of the shared folder.

    ``claims`` replaces fields by what a reader of the table holds instead, in the rows
    where ``claimed`` is true; their digest is kept beside the leaf for ``proofs``.
    Nulls have a form of their own; rows of the same key are told apart by their digest,
    a null key comes first; a null group is a tree like any other. An empty table has no
    leaves, nodes or root. Columns that are no fields are not looked at.
    """
    own = {name: F.col(name) for name in fields}
    claim = F.when(claimed, F.unhex(leaf_digest(own | (claims or {})))) if claimed is not None else F.lit(None).cast("binary")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("v"), F.col(group).cast("string")), F.lit("n")).alias("tree"),
        F.col(key).alias("doc_id"),
        F.unhex(leaf_digest(own)).alias("leaf"),
        claim.alias("claim"),
    )
    placed = _placed(leaves, ["doc_id", "leaf", "claim"])
    size = FAN**levels
    blocks = written(
        placed.groupBy("tree", "total", F.expr(f"place div {size}").alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("place", "doc_id", "leaf", "claim"))).alias("leaves")  # FAN ** levels at most
        ),
        "leaf-blocks",
    )
    hashes = F.expr("transform(leaves, x -> x.leaf)").alias("hashes")
    roots = map_batches(blocks.select("tree", "total", "block", hashes), _block_roots(levels), _NODES)
    nodes = _upper(written(roots, "block-roots"), levels)
    subroots = nodes.where("is_root").select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), F.col("hash").alias("leaf"))
    top = _placed(subroots, ["name"])
    top = written(top, "subroots")
    trees = top.select(F.col("name").alias("tree"), "place", F.col("total").alias("trees"))
    base = top.select(
        "tree", "total", F.lit(0).alias("level"), F.col("place").alias("idx"), F.col("leaf").alias("hash"),
        (F.col("total") == 1).alias("is_root"), F.lit(True).alias("is_last"),
    )
    return Manifest(blocks, nodes.unionByName(_upper(base, levels)), trees, levels)


def _placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with their place in the order of their tree, and its number of leaves.

    Rows are sorted by ranges and written; a row a range and tree counts them, so no task
    sees a whole tree.
    """
    dealt = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    rows = written(dealt.withColumn("at", F.monotonically_increasing_id()), "sorted-leaves")
    part = F.shiftright("at", 33)
    counts = rows.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = written(
        counts.select(
            "tree", "part", (F.col("first") - F.coalesce(before, F.lit(0))).alias("shift"), F.sum("n").over(tree).alias("total")
        ),
        "range-starts",
    )
    if keys_fit_broadcast(starts):
        starts = F.broadcast(starts)
    return (
        rows.withColumn("part", part).join(starts, ["tree", "part"]).withColumn("place", F.col("at") - F.col("shift")).drop("at", "part", "shift")
    )


_KINDS = {
    "tree": pa.string(), "total": pa.int64(), "level": pa.int32(), "idx": pa.int64(), "hash": pa.binary(),
    "is_root": pa.bool_(), "is_last": pa.bool_(),
}
_NODES = "tree string, total long, level int, idx long, hash binary, is_root boolean, is_last boolean"


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds.values(), strict=True)], list(kinds))


def _parents(hashes: list[str]) -> list[str]:
    return [digest(hashes[i : i + FAN]) for i in range(0, len(hashes), FAN)]


def _block_roots(levels: int):
    def task(batches: Batches) -> Batches:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                top = height(row["total"])
                level = min(levels, top)
                hashes = [x.hex() for x in row["hashes"]]
                for _ in range(level):
                    hashes = _parents(hashes)
                rows.append((row["tree"], row["total"], level, row["block"], bytes.fromhex(hashes[0]), level == top, True))
            yield _batch(rows, _KINDS)

    return task


def _upper(base: DataFrame, levels: int) -> DataFrame:
    """``base``, one level of each tree, and all levels above it, ``levels`` of them a step:
    the number of steps grows with the logarithm of a tree's size."""

    def task(batches: Batches) -> Batches:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                nodes = sorted(row["nodes"], key=lambda x: x["idx"])
                level, first, wide = row["level"], nodes[0]["idx"], width(row["total"], row["level"])
                hashes = [x["hash"].hex() for x in nodes]
                for k in range(levels):
                    hashes = _parents(hashes)
                    level, first, wide = level + 1, first // FAN, -(-wide // FAN)
                    last = wide == 1 or k == levels - 1
                    rows += [
                        (row["tree"], row["total"], level, first + i, bytes.fromhex(x), wide == 1, last) for i, x in enumerate(hashes)
                    ]
                    if wide == 1:
                        break
            yield _batch(rows, _KINDS)

    nodes = step = base
    while not (step := step.where("is_last AND NOT is_root")).isEmpty():
        part = F.expr(f"idx div {FAN**levels}").alias("part")
        grouped = step.groupBy("tree", "total", "level", part).agg(F.collect_list(F.struct("idx", "hash")).alias("nodes"))
        step = written(map_batches(grouped.drop("part"), task, _NODES), "nodes")
        nodes = nodes.unionByName(step)
    return nodes.drop("is_last")


def multiproofs(manifest: Manifest) -> DataFrame:
    """tree, block, nodes (array of at_tree, level, idx, hash): for each block the fewest nodes
    that lead its leaves to the roots of their tree and of all trees, and these two roots."""
    size = FAN**manifest.levels

    def task(batches: Batches) -> Batches:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                first, total, trees = row["block"] * size, row["total"], row["trees"]
                own = missing(range(first, first + row["n"]), total)
                top = missing([row["place"]], trees)
                rows += [(row["tree"], row["block"], row["tree"], *x) for x in [*own, (height(total), 0)]]
                rows += [(row["tree"], row["block"], TOP, *x) for x in [*top, (height(trees), 0)]]
            kinds = {"tree": pa.string(), "block": pa.int64(), "at_tree": pa.string(), "level": pa.int32(), "idx": pa.int64()}
            yield _batch(rows, kinds)

    blocks = manifest.blocks.select("tree", "total", "block", F.size("leaves").alias("n")).join(_checked(manifest.trees), "tree")
    wanted = map_batches(blocks, task, "tree string, block long, at_tree string, level int, idx long")
    nodes = manifest.nodes.select(F.col("tree").alias("at_tree"), "level", "idx", "hash")
    # A node of the blocks' step is wanted by the blocks of its run at most; those above, by
    # many blocks, are a few.
    above = (F.col("at_tree") == TOP) | (F.col("level") >= 2 * manifest.levels)
    on = ["at_tree", "level", "idx"]
    few = _checked(nodes.where(above))
    found = wanted.where(above).join(few, on).unionByName(wanted.where(~above).join(nodes.where(~above), on))
    return found.groupBy("tree", "block").agg(F.collect_list(F.struct(*on, "hash")).alias("nodes"))


def _checked(df: DataFrame) -> DataFrame:
    """``df``, a written table, marked for broadcast if its bytes are few enough."""
    texts = df.select(*(F.hex(c).alias(c) if kind == "binary" else c for c, kind in df.dtypes))
    return F.broadcast(df) if keys_fit_broadcast(texts) else df


def proofs(manifest: Manifest) -> DataFrame:
    """For every leaf: doc_id, leaf, subroot, root, proof (its siblings, 32 bytes each, level by
    level from the leaf to the root, left to right), folded_root (what its claim, or the leaf
    itself, and the siblings give) and verified (whether that is the root). Digests are
    lowercase hex; subroot and root are the manifest's own."""
    kind = manifest.blocks.schema["leaves"].dataType.elementType["doc_id"].dataType.simpleString()

    def task(batches: Batches) -> Batches:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                [row] = one.drop_columns(["leaves"]).to_pylist()
                leaves = one.column("leaves")[0].values
                yield _proved(row, leaves.field("place").to_pylist(), leaves.field("doc_id"), *(leaves.field(x).to_pylist() for x in ("leaf", "claim")))

    source = manifest.blocks.join(multiproofs(manifest), ["tree", "block"]).join(_checked(manifest.trees), "tree")
    return map_batches(
        source.select("tree", "total", "place", "trees", "nodes", "leaves"), task,
        f"doc_id {kind}, leaf string, subroot string, root string, proof binary, folded_root string, verified boolean",
    )


def _proved(row: dict, places: list[int], doc_ids: pa.Array, hashes: list[bytes], claims: list[bytes | None]) -> pa.RecordBatch:
    total, trees, place = row["total"], row["trees"], row["place"]
    fetched: dict[str, dict] = {row["tree"]: {}, TOP: {}}
    for x in row["nodes"]:
        fetched[x["at_tree"]][x["level"], x["idx"]] = x["hash"].hex()
    subroot, root = fetched[row["tree"]].pop((height(total), 0)), fetched[TOP].pop((height(trees), 0))
    leaves = [x.hex() for x in hashes]
    own = Paths(derive(fetched[row["tree"]] | {(0, i): x for i, x in zip(places, leaves, strict=True)}, total), total)
    derived = own.nodes[own.height, 0]
    top = Paths(derive(fetched[TOP] | {(0, place): derived}, trees), trees)
    rest, whole = top.siblings(place), top.nodes[top.height, 0]
    folded = [whole if c is None else top.fold(place, own.fold(i, c.hex())) for i, c in zip(places, claims, strict=True)]
    n = len(places)
    return pa.record_batch(
        [
            doc_ids, pa.array(leaves), pa.array([subroot] * n), pa.array([root] * n),
            pa.array([own.siblings(i) + rest for i in places], pa.binary()),
            pa.array(folded), pa.array([x == root for x in folded]),
        ],
        ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"],
    )
