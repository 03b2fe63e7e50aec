"""Jaccard join of word n-grams (shingles) with count vectors in R-trees.

Documents meet in blocks: those that share a shingle among the rarest quarter of their
own (sets as similar as wanted must share one of these). A block's documents are first
compared with one or two of them; what then is still in different components goes through an
R-tree over count vectors: shingles are hashed into groups, a node keeps the largest count
of each group, and the sum of the smaller counts bounds how many shingles two sets share.
Surviving pairs are verified on the sets themselves.
"""

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.batches import BROADCAST_ROWS, Batches, documents, lower_ascii, map_batches, small
from pulsegrid.llm.components import connected_components
from pulsegrid.session import written

#: Words of a shingle; least similarity in hundredths.
WORDS, PERCENT = 5, 75
#: Shingles a group of a count vector holds on average, about; least and most groups. Counts
#: are bytes, FULL stands for that many or more.
PER_GROUP, LEAST_GROUPS, MOST_GROUPS, FULL = 1, 16, 1 << 14, 255
#: What an R-tree's 16-bit counts hold at most, and what 32-bit ones do, taken when a set is
#: larger than that; stands also for FULL.
MOST, WIDE = (1 << 15) - 1, (1 << 31) - 1
#: Leading bits of a shingle's hash by which its frequency is estimated.
FREQUENCY_BITS = 20
#: Postings a task gathers before it sends them, and shingle ranges they are sent to.
GATHER, RANGES = 1 << 18, 1024
#: Documents of one shingle that are kept in one row, and of a salt when sets are compared.
CHUNK, SALT = 4096, 64
#: Partners of a document in the first search of a tree.
FIRST_PARTNERS = 2
#: Entries of an R-tree's leaf and children of a node.
LEAF, FANOUT = 64, 8
MEMO = 100_000
#: Bytes of a table that is broadcast, and of sets sent in one batch, about.
BROADCAST_BYTES, SENT_BYTES = 64 << 20, 8 << 20


def _windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive words, given theirs."""
    total = np.full(max(len(h) - size + 1, 0), size, np.uint64)
    for i in range(size):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += h[i : i + len(total)]
        total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    return total


def shingle_sets(texts: list[bytes], size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each lower-case text.

    Words are what ASCII white space separates. A text of fewer words is one shingle. The
    texts of a batch are hashed in one go; windows across two texts are left out.
    """
    words = [text.split() for text in texts]
    ends = np.cumsum([len(x) for x in words], dtype=np.int64).tolist()
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, chain.from_iterable(words))), ">u8").astype(np.uint64)
    total, start, found = _windows(h, size), 0, []
    for end in ends:
        if end - start < size:
            values = _windows(h[start:end], end - start) if end > start else np.zeros(0, np.uint64)
        else:
            values = np.sort(total[start : end - size + 1])
            values = values[np.append(True, values[1:] != values[:-1])]
        found.append(values)
        start = end
    return found


def point_of(shingles: np.ndarray) -> np.ndarray:
    """The count vector of a set: shingles by their hash modulo a power of two that grows
    with the set."""
    groups = min(max(LEAST_GROUPS, 1 << (len(shingles) // PER_GROUP).bit_length()), MOST_GROUPS)
    counts = np.bincount((shingles % np.uint64(groups)).astype(np.int64), minlength=groups)
    return np.minimum(counts, FULL).astype(np.uint8)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """A count vector over fewer groups: a power of two divides into the smaller one."""
    return point.astype(np.int32).reshape(-1, groups).sum(0)


def vectors_of(points: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Count vectors folded to the fewest groups among them. A count is at most its set's
    size, so what is clipped never bounds."""
    groups, most = min(map(len, points)), MOST if sizes.max() <= MOST else WIDE
    # a full group may hold more: it never bounds
    full = [np.where(p == FULL, np.int64(most), p).reshape(-1, groups).sum(0) for p in points]
    return np.stack([np.minimum(x, most) for x in full]).astype(np.int16 if most == MOST else np.int32)


def most_shared(p: np.ndarray, q: np.ndarray) -> int:
    """No more shingles than this can be in both sets: the sum of the smaller counts."""
    if p.max(initial=0) == FULL or q.max(initial=0) == FULL:
        return 1 << 60
    groups = min(len(p), len(q))
    return int(np.minimum(folded(p, groups), folded(q, groups)).sum())


def text_key(text: Column) -> Column:
    """A 64-bit hash of a text in lower case; a null text is empty."""
    return F.xxhash64(lower_ascii(F.coalesce(text, F.lit(""))))


def key_of(lowered: bytes) -> int:
    """What ``text_key`` gives, of a text in lower case."""
    value = xxhash.xxh64_intdigest(lowered, 42)
    return value - (1 << 64) if value >> 63 else value


def _raw(docs: DataFrame) -> DataFrame:
    """doc_id, text as bytes, in whatever case: tasks lower it for less than ``translate``."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"))


def _sizes_and_frequencies(docs: DataFrame, size: int) -> tuple[DataFrame, np.ndarray]:
    """Rows (doc_id, key, n) in a written table, and how often each range of hashes occurs
    in the whole corpus: a fixed number of counters, summed in pieces."""
    pieces = 64

    def task(batches: Batches) -> Batches:
        counts = np.zeros(1 << FREQUENCY_BITS, np.int64)
        shift = np.uint64(64 - FREQUENCY_BITS)
        for batch in batches:
            n, keys = [], []
            texts = [text.lower() for text in batch.column("text").to_pylist()]
            for text, found in zip(texts, shingle_sets(texts, size), strict=True):
                n.append(len(found))
                keys.append(key_of(text))
                np.add.at(counts, found >> shift, 1)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())],
                ["doc_id", "key", "n", "piece", "counts"],
            )
        yield pa.record_batch(
            [pa.nulls(pieces, batch_type), pa.nulls(pieces, pa.int64()), pa.nulls(pieces, pa.int64()), pa.array(range(pieces), pa.int32()),
             pa.array([zlib.compress(x.tobytes(), 1) for x in np.split(counts, pieces)], pa.binary())],
            ["doc_id", "key", "n", "piece", "counts"],
        )

    kind = docs.schema["doc_id"].dataType
    batch_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    both = written(
        map_batches(_raw(docs), task, f"doc_id {kind.simpleString()}, key long, n long, piece int, counts binary"), "sizes"
    )

    def add(batches: Batches) -> Batches:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(zlib.decompress(data), np.int64)
                sums[piece] = sums[piece] + values if piece in sums else values
        yield pa.record_batch(
            [pa.array(sums.keys(), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["piece", "counts"]
        )

    parts = map_batches(both.where("piece IS NOT NULL").select("piece", "counts").repartition("piece"), add, "piece int, counts binary")
    counts = np.zeros(1 << FREQUENCY_BITS, np.int64)
    for piece, data in parts.collect():  # 64 rows, 8 MiB in all
        counts.reshape(pieces, -1)[piece] = np.frombuffer(data, np.int64)
    return both.where("piece IS NULL").select("doc_id", "key", "n"), counts


def _postings(docs: DataFrame, frequencies: np.ndarray, size: int, percent: int) -> DataFrame:
    """Shingles with two documents at least and the keys of these: shingle, keys (sorted, at
    most CHUNK). Only a document's rarest shingles count, as many as any partner must share
    one of. They travel packed, a row for each task and range of hashes."""
    spark = docs.sparkSession
    ranges = max(RANGES, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = spark.sparkContext.broadcast(np.minimum(frequencies, 2**31 - 1).astype(np.int32))  # 4 MiB

    def prefixes(batches: Batches) -> Batches:
        counts, shift = shared.value, np.uint64(64 - FREQUENCY_BITS)
        seen: set[int] = set()
        parts: list[tuple[np.ndarray, int]] = []
        gathered = 0

        def packed() -> pa.RecordBatch:
            found = np.concatenate([p for p, _ in parts]) if parts else np.zeros(0, np.uint64)
            keys = np.repeat(np.array([k for _, k in parts], np.int64), [len(p) for p, _ in parts])
            into = (found % np.uint64(ranges)).astype(np.int64)
            order = np.argsort(into, kind="stable")
            into, found, keys = into[order], found[order], keys[order]
            starts = np.flatnonzero(np.diff(into, prepend=-1))
            ends = [*starts[1:].tolist(), len(into)][: len(starts)]
            rows = list(zip(starts.tolist(), ends, strict=True))
            return pa.record_batch(
                [pa.array(into[starts], pa.int64()), pa.array([found[s:e].tobytes() for s, e in rows], pa.binary()),
                 pa.array([keys[s:e].tobytes() for s, e in rows], pa.binary())],
                ["part", "shingles", "keys"],
            )

        for batch in batches:
            fresh = {}
            for text in batch.column("text").to_pylist():
                lowered = text.lower()
                key = key_of(lowered)
                if key in seen:  # a copy of a text of this task adds nothing
                    continue
                if len(seen) > MEMO:
                    seen.clear()
                seen.add(key)
                fresh[key] = lowered
            for key, found in zip(fresh, shingle_sets(list(fresh.values()), size), strict=True):
                if not len(found):
                    continue
                length = len(found) - -(-percent * len(found) // 100) + 1
                order = np.lexsort((found, counts[found >> shift]))[:length]
                parts.append((found[order], key))
                gathered += length
            if gathered >= GATHER:
                yield packed()
                parts, gathered = [], 0
        yield packed()

    def gather(batches: Batches) -> Batches:
        found, keys = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            found += [np.frombuffer(x, np.uint64) for x in batch.column("shingles").to_pylist()]
            keys += [np.frombuffer(x, np.int64) for x in batch.column("keys").to_pylist()]
        all_found, all_keys = np.concatenate(found), np.concatenate(keys)
        del found, keys
        order = np.argsort(all_found, kind="stable")
        all_found, all_keys = all_found[order], all_keys[order]
        del order
        starts = np.flatnonzero(np.concatenate([[True], all_found[1:] != all_found[:-1]])) if len(all_found) else np.zeros(0, int)
        ends = np.append(starts[1:], len(all_found))
        many = ends - starts > 1
        shingles, lists, known = [], [], set()
        for s, e in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
            group = np.unique(all_keys[s:e])
            if len(group) < 2:
                continue
            if len(group) <= SALT:  # the same documents often share many shingles
                same = group.tobytes()
                if same in known:
                    continue
                if len(known) > MEMO:
                    known.clear()
                known.add(same)
            for at in range(0, len(group), CHUNK):
                shingles.append(all_found[s].astype(np.int64))
                lists.append(group[at : at + CHUNK])
            if len(shingles) >= 10_000:
                yield _block_rows(shingles, lists)
                shingles, lists = [], []
        yield _block_rows(shingles, lists)

    sent = map_batches(_raw(docs).select("text"), prefixes, "part long, shingles binary, keys binary")
    return written(map_batches(sent.repartition("part"), gather, "shingle long, keys array<long>"), "blocks")


def _block_rows(shingles: list, lists: list) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    values = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    return pa.record_batch(
        [pa.array(np.array(shingles, np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["shingle", "keys"]
    )


def _texts_of(docs: DataFrame, rows: DataFrame, wanted: DataFrame, weight: Column) -> DataFrame:
    """One text in lower case for each key of ``wanted`` (unique by key; a row has about
    ``weight`` bytes), with wanted's other columns; a row that comes twice may give it twice.

    Rows whose id was not chosen are left out first, so few keys are computed.
    """
    first = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("chosen"))
    chosen = written(wanted.join(first, "key"), "chosen")
    count, size = chosen.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    if count <= BROADCAST_ROWS:
        ids = chosen.select(F.col("chosen").alias("id")).distinct()
        docs = docs.join(F.broadcast(ids), docs["doc_id"].eqNullSafe(ids["id"]), "left_semi")
    ascii_only = F.octet_length("text") == F.char_length("text")  # lower() is as good there and cheaper
    lowered = docs.select("doc_id", F.when(ascii_only, F.lower("text")).otherwise(lower_ascii(F.col("text"))).alias("text"))
    keyed = lowered.select("doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))
    fits = count <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    of_key = keyed.join(F.broadcast(chosen) if fits else chosen, "key")
    return of_key.where(F.col("doc_id").eqNullSafe(F.col("chosen"))).drop("chosen", "doc_id")


def _points(docs: DataFrame, rows: DataFrame, blocks: DataFrame, size: int) -> DataFrame:
    """Count vectors of all documents that stand in blocks: key, n, point."""

    def vectors(batches: Batches) -> Batches:
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), size)
            yield pa.record_batch(
                [batch.column("key"), pa.array(map(len, sets), pa.int64()), pa.array([point_of(x).tobytes() for x in sets], pa.binary())],
                ["key", "n", "point"],
            )

    wanted = blocks.select(F.explode("keys").alias("key")).distinct()
    found = map_batches(_texts_of(docs, rows, wanted, F.lit(16)).select("key", "text"), vectors, "key long, n long, point binary")
    return written(found.dropDuplicates(["key"]), "points")


def _within_bound(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and count vectors allow the similarity."""

    def check(batches: Batches) -> Batches:
        for batch in batches:
            a, b, n, m, p, q = (c.to_pylist() for c in batch.columns)
            kept = [
                (100 + percent) * most_shared(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) >= percent * (i + j)
                for i, j, x, y in zip(n, m, p, q, strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    of_a = points.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("point").alias("point_a"))
    of_b = points.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("point").alias("point_b"))
    near = (
        pairs.select("a", "b").distinct().join(of_a.select("a", "n_a"), "a").join(of_b, "b")
        .where((100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a")))
        .join(of_a.select("a", "point_a"), "a")
        .select("a", "b", "n_a", "n_b", "point_a", "point_b")
    )
    return map_batches(near, check, "a long, b long")


def _verified(docs: DataFrame, rows: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. a's set meets those of its partners,
    SALT of them at a time; one shuffle of the sets, each text read once."""
    pairs = written(pairs, "pairs")
    salted = pairs.join(pairs.groupBy("a").count(), "a").withColumn(
        "salt", F.pmod(F.xxhash64("b"), F.greatest(F.col("count") / SALT, F.lit(1)).cast("long"))
    )
    partners = salted.select(F.col("b").alias("key"), F.struct("a", "salt").alias("to"))
    heads = salted.select(F.col("a").alias("key"), F.struct("a", "salt").alias("to"))
    targets = partners.unionByName(heads).groupBy("key").agg(F.collect_set("to").alias("to"))

    def sets(batches: Batches) -> Batches:
        kinds = {"a": pa.int64(), "salt": pa.int64(), "own": pa.bool_(), "key": pa.int64(), "set": pa.binary()}
        found: dict[str, list] = {name: [] for name in kinds}
        held = 0

        def sent() -> pa.RecordBatch:
            return pa.record_batch([pa.array(found[name], kind) for name, kind in kinds.items()], list(kinds))

        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), size)
            for key, values, targets in zip(batch.column("key").to_pylist(), sets, batch.column("to").to_pylist(), strict=True):
                data = values.tobytes()
                for to in targets:
                    for name, value in (("a", to["a"]), ("salt", to["salt"]), ("own", to["a"] != key), ("key", key), ("set", data)):
                        found[name].append(value)
                    held += len(data)
                    if held >= SENT_BYTES:
                        yield sent()
                        found, held = {name: [] for name in kinds}, 0
        yield sent()

    def compare(batches: Batches) -> Batches:
        place, head = None, np.zeros(0, np.uint64)
        for batch in batches:
            a_out, b_out = [], []
            for a, salt, other, key, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = np.frombuffer(data, np.uint64)
                if not other:
                    place, head = (a, salt), values
                elif place == (a, salt):
                    low, high = sorted((len(values), len(head)))
                    if 100 * low >= percent * high:
                        both = len(np.intersect1d(head, values, assume_unique=True))
                        if 100 * both >= percent * (low + high - both):
                            a_out.append(a)
                            b_out.append(key)
            yield pa.record_batch([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    sent = map_batches(_texts_of(docs, rows, targets, 32 + 24 * F.size("to")), sets, "a long, salt long, own boolean, key long, set binary")
    dealt = sent.repartition("a", "salt").sortWithinPartitions("a", "salt", "own")
    return written(map_batches(dealt, compare, "a long, b long"), "links")


def tree_pairs(
    vectors: np.ndarray, sizes: np.ndarray, groups: np.ndarray, percent: int, most: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, of different ``groups``, whose count vectors allow the similarity; with
    ``most`` only so many of each row's, those of the largest bounds.

    The tree is packed bottom up over rows in order of size and of their fullest groups of
    shingles; a node holds the largest counts below it, the range of sizes and the group,
    if it is one.
    """
    n = len(sizes)
    if n <= LEAF:  # the tree is one leaf
        i, j = np.triu_indices(n, 1)
        near = (groups[i] != groups[j]) & (100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j]))
        i, j = i[near], j[near]
        step = max(1, SENT_BYTES // max(1, vectors[0].nbytes)) if n else 1
        cuts = [slice(at, at + step) for at in range(0, len(i), step)]
        bound = np.concatenate([np.zeros(0, np.int64), *(np.minimum(vectors[i[c]], vectors[j[c]]).sum(1, dtype=np.int64) for c in cuts)])
        good = (100 + percent) * bound >= percent * (sizes[i] + sizes[j])
        i, j, bound = i[good], j[good], bound[good]
        if most is not None and len(i):
            best = np.lexsort((-bound / (sizes[i] + sizes[j]), i))
            i, j = i[best], j[best]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < most
            i, j = i[kept], j[kept]
        return i, j
    order = np.lexsort((*(vectors[:, k] for k in np.argsort(-vectors.var(0))[:3]), sizes))
    v, s, g = vectors[order].astype(np.int16 if sizes.max(initial=0) <= MOST else np.int32), sizes[order], groups[order]

    def packed(top, low, high, group, width):
        starts = np.arange(0, len(low), width)
        same = np.maximum.reduceat(group, starts) == np.minimum.reduceat(group, starts)
        return (np.maximum.reduceat(top, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts),
                np.where(same, group[starts], -1))

    levels = [packed(v, s, s, g, LEAF)]
    while len(levels[-1][1]) > 1:
        levels.append(packed(*levels[-1], FANOUT))
    left, right = [], []
    for i in range(n):
        nodes = np.zeros(1, np.int64)
        for depth in range(len(levels) - 1, -1, -1):
            top, low, high, group = (x[nodes] for x in levels[depth])
            least = np.maximum(low, -(-percent * s[i] // 100))
            open_ = (least <= high) & (100 * s[i] >= percent * low) & (group != g[i])
            # rows before i have looked at i themselves
            last = (nodes + 1) * LEAF * FANOUT**depth - 1
            open_ &= last > i
            nodes, top, least = nodes[open_], top[open_], least[open_]
            bound = np.minimum(top, v[i]).sum(1, dtype=np.int64)
            nodes = nodes[(100 + percent) * bound >= percent * (s[i] + least)]
            width = FANOUT if depth else LEAF
            nodes = (nodes[:, None] * width + np.arange(width)).ravel()
            nodes = nodes[nodes < (len(levels[depth - 1][1]) if depth else n)]
            if not len(nodes):
                break
        if not len(nodes):
            continue
        nodes = nodes[(nodes > i) & (g[nodes] != g[i])]
        low, high = np.minimum(s[nodes], s[i]), np.maximum(s[nodes], s[i])
        nodes = nodes[100 * low >= percent * high]
        bound = np.minimum(v[nodes], v[i]).sum(1, dtype=np.int64)
        good = (100 + percent) * bound >= percent * (s[nodes] + s[i])
        nodes, bound = nodes[good], bound[good]
        if most is not None and len(nodes) > most:
            nodes = nodes[np.argsort(-bound / (s[nodes] + s[i]), kind="stable")[:most]]
        left.append(np.full(len(nodes), order[i]))
        right.append(order[nodes])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def may_pair(sizes: np.ndarray, groups: np.ndarray, percent: int) -> np.ndarray:
    """Which rows have another one of a different group whose size allows the similarity."""
    ranks = np.unique(groups, return_inverse=True)[1].astype(np.int64) << 40  # sets are smaller than that
    least, most = -(-percent * sizes // 100), 100 * sizes // percent

    def within(values: np.ndarray, of: np.ndarray | int) -> np.ndarray:
        return np.searchsorted(values, of + most, "right") - np.searchsorted(values, of + least, "left")

    return within(np.sort(sizes), 0) > within(np.sort(ranks + sizes), ranks)


def _across(blocks: DataFrame, roots: DataFrame, points: DataFrame, percent: int, most: int | None) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) within blocks but across components, from R-trees; and the
    shingles of blocks that may hold more pairs than ``most`` a row let through.

    Rows that have no partner of their size in another component leave a tree before the
    count vectors are sent.
    """
    members = (
        blocks.select("shingle", F.explode("keys").alias("key"))
        .join(small(roots.select(F.col("node").alias("key"), "root")), "key", "left")
        .select("shingle", "key", F.coalesce("root", "key").alias("root"))
    )
    mixed = members.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m"))
    mixed = mixed.where("low <> high").select("shingle", "m")
    rest = written(members.join(mixed, "shingle").join(small(points.select("key", "n")), "key"), "members")

    # a block of more than CHUNK documents is dealt to pairs of its parts
    parts = F.greatest(F.ceil(F.col("m") / (CHUNK // 2)), F.lit(1))
    dealt = (
        rest.withColumn("parts", parts.cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("shingle", "key", "root", "n", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    )
    trees = (
        dealt.groupBy("shingle", "p", "q")
        .agg(F.sort_array(F.collect_set(F.struct("key", "root", "n"))).alias("members"))
        .groupBy("members")
        .agg(F.min("shingle").alias("shingle"))
    )
    trees = written(trees.withColumn("tree", F.xxhash64("members")), "trees")

    def prune(batches: Batches) -> Batches:
        for batch in batches:
            lists = batch.column("members")
            flat = lists.flatten()
            key, root, n = (flat.field(k).to_numpy() for k in range(3))
            lengths = lists.value_lengths().to_numpy()
            ends = np.cumsum(lengths)
            tree = np.repeat(batch.column("tree").to_numpy(), lengths)
            kept = np.zeros(len(key), bool)
            for start, end in zip((ends - lengths).tolist(), ends.tolist(), strict=True):
                kept[start:end] = may_pair(n[start:end], root[start:end], percent)
            yield pa.record_batch([pa.array(x[kept]) for x in (tree, key, root, n)], ["tree", "key", "root", "n"])

    entries = map_batches(trees.select("tree", "members"), prune, "tree long, key long, root long, n long")
    entries = entries.join(points.select("key", "point"), "key")

    def search(batches: Batches) -> Batches:
        tree, held = None, []

        def pairs() -> tuple[np.ndarray, bool]:
            if len(held) < 2:
                return np.zeros((0, 2), np.int64), False
            keys = np.array([x[0] for x in held])
            points = [np.frombuffer(x[3], np.uint8) for x in held]
            sizes = np.array([x[2] for x in held])
            i, j = tree_pairs(vectors_of(points, sizes), sizes, np.array([x[1] for x in held]), percent, most)
            more = most is not None and len(i) > 0 and bool(np.bincount(i).max() >= most)
            # the tree's vectors are as short as its shortest; a pair's own may tell more
            near = [
                (100 + percent) * most_shared(points[x], points[y]) >= percent * int(sizes[x] + sizes[y])
                for x, y in zip(i.tolist(), j.tolist(), strict=True)
            ]
            near = np.array(near, bool)
            return np.sort(np.column_stack([keys[i[near]], keys[j[near]]]), axis=1), more

        def found(out: list[np.ndarray], unfinished: list[int]) -> pa.RecordBatch:
            rows = _pair_rows(np.concatenate(out))
            a = pa.concat_arrays([rows.column("a"), pa.array(unfinished, pa.int64())])
            return pa.record_batch([a, pa.concat_arrays([rows.column("b"), pa.nulls(len(unfinished), pa.int64())])], ["a", "b"])

        for batch in batches:
            out, unfinished = [np.zeros((0, 2), np.int64)], []
            for t, key, root, n, point in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t != tree:
                    near, more = pairs()
                    out.append(near)
                    if more:
                        unfinished.append(tree)
                    tree, held = t, []
                held.append((key, root, n, point))
            yield found(out, unfinished)
        near, more = pairs()
        yield found([near], [tree] if more else [])

    dealt = entries.select("tree", "key", "root", "n", "point").repartition("tree").sortWithinPartitions("tree")
    both = written(map_batches(dealt, search, "a long, b long"), "candidates")
    unfinished = both.where("b IS NULL").select(F.col("a").alias("tree")).distinct()
    shingles = trees.select("tree", "shingle").join(unfinished, "tree").select("shingle").distinct()
    return both.where("b IS NOT NULL").distinct(), shingles


def _pair_rows(pairs: np.ndarray) -> pa.RecordBatch:
    """Distinct rows (a, b)."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    if len(pairs):
        pairs = pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(1))]
    return pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def similar_documents(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", keys: bool = False
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id it is linked
    with, directly or not, itself included).

    Documents link when their sets of shingles have a Jaccard similarity of ``percent``
    hundredths or more; no link between different texts is lost. A null or empty text, or
    one of white space, has no shingles and is linked with nothing. Repeated rows are each
    returned; a null id never is the smallest. Other columns are not looked at. Texts and
    shingles are told apart by 64-bit hashes. With ``keys`` also text_key and
    root, a component's own number, null without shingles.
    """
    texts = documents(docs, id_col, text_col)
    rows, frequencies = _sizes_and_frequencies(texts, words)
    blocks = _postings(texts, frequencies, words, percent)
    points = _points(texts, rows, blocks, words)
    # one or two partners a document: the smallest head of its blocks, and its largest block's
    head = F.struct(F.element_at("keys", 1).alias("a"), F.size("keys").alias("m"))
    stars = (
        blocks.select(head.alias("head"), F.explode("keys").alias("b"))
        .groupBy("b")
        .agg(F.min("head.a").alias("least"), F.max_by("head.a", F.struct("head.m", "head.a")).alias("large"))
        .select(F.explode(F.array_distinct(F.array("least", "large"))).alias("a"), "b")
        .where("a <> b")
    )
    stars = _within_bound(stars, points, percent)
    near = _verified(texts, rows, stars, words, percent)
    # Each document's most promising partners in other components first: most components
    # grow together over these. Then all that the trees let pass between what is left, in
    # the blocks where a document may have had more partners than these.
    links, roots, open_blocks = near, connected_components(near), blocks
    for most in (FIRST_PARTNERS, None):
        candidates, unfinished = _across(open_blocks, roots, points, percent, most)
        links = links.unionByName(_verified(texts, rows, candidates, words, percent))
        roots = connected_components(links)
        if unfinished.isEmpty():
            break
        open_blocks = written(blocks.join(small(unfinished), "shingle", "left_semi"), "open")
    placed = rows.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select(
        "doc_id", "n", "key", F.when(F.col("n") > 0, F.coalesce("root", "key")).alias("root")
    )
    least = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"),
        *((F.col("key").alias("text_key"), "root") if keys else ()),
    )
