"""Ranked lexical search with a length-stratified index.

The index is made of shards of documents. Within a shard documents of equal length
normaliser m form a stratum, and a term's postings go by stratum and, in it, by term
frequency. A search visits the strata of a shard by the largest score they can hold,
highest first, and stops where that is below the last of the best documents found; what a
frequency is worth is worked out once for a stratum and not for each document.
"""

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.batches import Batches, map_batches
from pulsegrid.operators.joins import keys_fit_broadcast
from pulsegrid.session import written

#: Postings and documents a shard holds at most, but for its last document.
SHARD_POSTINGS, SHARD_DOCS = 1 << 21, 1 << 15
#: Documents an answer names.
BEST = 50
#: Terms of items (with repeats over items) that one search takes; more go in further ones.
BLOCK_TERMS = 20_000

#: Every byte that is part of a term as itself, A-Z in lower case, all others as blanks.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: digits, letters a to z and all that is not ASCII."""
    return text.translate(_FOLD).split()


def normaliser(n: int, documents: int, terms: int) -> int:
    """m of a document with n terms, among so many documents and terms."""
    return 100 - 50 + (50 * n * documents) // terms


class Index(NamedTuple):
    """``postings``: shard, term, n, docs, tfs (n documents by (m, tf, place), as 32-bit
    integers). ``shards``: shard, doc_ids, ms, ranks: each document's id, normaliser and
    rank by id; a document's place is its index there, and places ascend by (m, id).
    ``documents`` and ``terms``: their number, with repeats."""

    postings: DataFrame
    shards: DataFrame
    documents: int
    terms: int


def _texts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def _sizes(texts: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms of all documents."""

    def task(batches: Batches) -> Batches:
        for batch in batches:
            sizes = [len(terms_of(x)) for x in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array([sum(n > 0 for n in sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], ["documents", "terms"])

    sums = map_batches(texts.select("text"), task, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return sums[0] or 0, sums[1] or 0


def write_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", postings: int = SHARD_POSTINGS) -> Index:
    """Index every row of ``docs``, whole texts, in tables of the shared folder.

    Two passes over the texts, none shuffles: one counts documents and terms, which give
    the normalisers, one writes shards. A null or empty text has no terms and is in no
    shard; repeated rows are documents of their own; a null id is kept; other columns are
    not looked at. Without any term the index is empty.
    """
    texts = _texts(docs, id_col, text_col)
    documents, terms = _sizes(texts)
    kind = texts.schema["id"].dataType.simpleString()

    def task(batches: Batches) -> Batches:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        open_shard = _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts = Counter(terms_of(text))
                if counts:
                    open_shard.add(doc_id, normaliser(counts.total(), documents, terms), counts)
                if open_shard.size >= postings or len(open_shard.doc_ids) >= SHARD_DOCS:
                    yield from open_shard.batches(shard, id_type)
                    open_shard, shard = _Shard(), shard + 1
        if open_shard.doc_ids:
            yield from open_shard.batches(shard, id_type)

    id_type = {"string": pa.string(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kind, pa.int64())
    rows = texts if kind in ("string", "int", "smallint", "tinyint", "bigint") else texts.withColumn("id", F.col("id").cast("long"))
    id_name = rows.schema["id"].dataType.simpleString()
    index = written(
        map_batches(rows, task, f"shard long, term string, n int, docs binary, tfs binary, doc_ids array<{id_name}>, ms binary, ranks binary"),
        "lexical-index",
    )
    return Index(
        index.where("term IS NOT NULL").select("shard", "term", "n", "docs", "tfs"),
        index.where("term IS NULL").select("shard", "doc_ids", "ms", "ranks"),
        documents, terms,
    )


class _Shard:
    """Documents gathered for one shard."""

    def __init__(self):
        self.doc_ids: list = []
        self.ms: list[int] = []
        self.vocabulary: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, m: int, counts: Counter) -> None:
        known = self.vocabulary
        n = len(counts)
        self.terms.append(np.fromiter((known.setdefault(t, len(known)) for t in counts), np.int32, n))
        self.tfs.append(np.fromiter(counts.values(), np.int32, n))
        self.doc_ids.append(doc_id)
        self.ms.append(m)
        self.size += n

    def batches(self, shard: int, id_type: pa.DataType) -> Batches:
        count = len(self.doc_ids)
        by_id = sorted(range(count), key=lambda i: (self.doc_ids[i] is not None, self.doc_ids[i] or type(self.doc_ids[i])()))
        rank = np.empty(count, np.int32)
        rank[by_id] = np.arange(count, dtype=np.int32)
        ms = np.array(self.ms, np.int64)
        order = np.lexsort((rank, ms))
        place = np.empty(count, np.int32)
        place[order] = np.arange(count, dtype=np.int32)
        docs = np.repeat(place, [len(x) for x in self.terms])
        terms, tfs = np.concatenate(self.terms), np.concatenate(self.tfs)
        # places ascend by m, so the stratum of a place comes before its frequency
        stratum = np.searchsorted(np.unique(ms), ms[order]).astype(np.int32)
        by = np.lexsort((docs, tfs, stratum[docs], terms))
        docs, tfs = docs[by], tfs[by]
        ends = np.cumsum(np.bincount(terms, minlength=len(self.vocabulary)))
        doc_ids = pa.array([[self.doc_ids[i] for i in order]], pa.list_(id_type))
        yield _rows(shard, [None], [count], [None], [None], doc_ids, [ms[order].tobytes()], [rank[order].tobytes()])
        words = list(self.vocabulary)
        all_docs, all_tfs = docs.tobytes(), tfs.tobytes()
        starts = np.concatenate([[0], ends[:-1]])
        for at in range(0, len(words), 20_000):
            some = slice(at, at + 20_000)
            bounds = list(zip((4 * starts[some]).tolist(), (4 * ends[some]).tolist(), strict=True))
            none = [None] * len(bounds)
            yield _rows(
                shard, [w.decode() for w in words[some]], (ends[some] - starts[some]).tolist(),
                [all_docs[a:b] for a, b in bounds], [all_tfs[a:b] for a, b in bounds], pa.array(none, pa.list_(id_type)), none, none,
            )


def _rows(shard: int, terms, n, docs, tfs, doc_ids: pa.Array, ms, ranks) -> pa.RecordBatch:
    return pa.record_batch(
        [
            pa.array([shard] * len(terms), pa.int64()), pa.array(terms, pa.string()), pa.array(n, pa.int32()),
            pa.array(docs, pa.binary()), pa.array(tfs, pa.binary()), doc_ids, pa.array(ms, pa.binary()), pa.array(ranks, pa.binary()),
        ],
        ["shard", "term", "n", "docs", "tfs", "doc_ids", "ms", "ranks"],
    )


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (a number for each row), item_id, term: the distinct terms of every item."""
    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    known = written(numbered, "items")

    def task(batches: Batches) -> Batches:
        for batch in batches:
            lists = [sorted(set(terms_of(x))) for x in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("item"), pa.array([[t.decode() for t in x] for x in lists], pa.list_(pa.string()))], ["item", "terms"]
            )

    texts = known.select("item", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    terms = map_batches(texts, task, "item long, terms array<string>").select("item", F.explode("terms").alias("term"))
    return known.select("item", "item_id").join(terms, "item")


def search(index: Index, items: DataFrame, best: int = BEST, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``best`` documents of every item: item_id, rank (from 1), doc_id, score.

    A document's score sums over the item's distinct terms, once each, their weight
    floor(1000 ln((2N + 2) / (2 df + 1))) times (10^9 tf) div (1000 tf + 20 m), N the
    indexed documents and df those with the term. Only scores above 0 count; equal ones go
    by ascending doc_id, null first. Rows of ``items`` with the same id are answered one by
    one; an item without terms, or whose terms no document has, has no rows. Items are
    taken in blocks of bounded size, each one pass over the postings of its terms.
    """
    terms = written(item_terms(items, id_col, text_col), "item-terms")
    sizes = terms.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    blocks = 0 if not total or not index.documents else -(-total // BLOCK_TERMS)
    doc_type = index.shards.schema["doc_ids"].dataType.elementType.simpleString()
    found = [_search_block(index, terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k), best, doc_type) for k in range(blocks)]
    answers = found[0] if found else terms.sparkSession.createDataFrame([], f"item long, doc_id {doc_type}, score long")
    for more in found[1:]:
        answers = answers.unionByName(more)
    if found:
        answers = written(answers, "shard-answers")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    ranked = answers.withColumn("rank", place).where(F.col("rank") <= best)
    names = terms.select("item", "item_id").distinct()
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def _search_block(index: Index, terms: DataFrame, best: int, doc_type: str) -> DataFrame:
    """item, doc_id, score: the ``best`` documents of each shard for the items of ``terms``."""
    asked = terms.select("term").distinct()
    asked = F.broadcast(asked) if keys_fit_broadcast(asked) else asked
    met = written(index.postings.join(asked, "term", "left_semi"), "met-postings")
    df = met.groupBy("term").agg(F.sum("n").alias("df"))
    ratio = F.lit(2.0 * index.documents + 2.0) / (2 * F.col("df") + 1)
    weighed = terms.join(df, "term").select("item", "term", F.floor(1000 * F.log(ratio)).alias("w")).where("w > 0")
    # BLOCK_TERMS rows, about: the items of a block
    words: dict[str, int] = {}
    lists: dict[int, list[tuple[int, int]]] = {}
    for row in weighed.collect():
        lists.setdefault(row["item"], []).append((words.setdefault(row["term"], len(words)), row["w"]))
    queries = {item: ([t for t, _ in x], [w for _, w in x]) for item, x in lists.items()}

    def task(batches: Batches) -> Batches:
        for batch in batches:
            for k in range(batch.num_rows):
                yield _answers(batch.slice(k, 1), words, queries, best)

    # a shard's postings are bounded by SHARD_POSTINGS
    grouped = met.groupBy("shard").agg(F.collect_list(F.struct("term", "docs", "tfs")).alias("postings"))
    return map_batches(grouped.join(index.shards, "shard"), task, f"item long, doc_id {doc_type}, score long")


def _answers(row: pa.RecordBatch, words: dict[str, int], queries: dict, best: int) -> pa.RecordBatch:
    """The best documents of one shard for every item."""
    ms = np.frombuffer(row.column("ms")[0].as_py(), np.int64)
    ranks = np.frombuffer(row.column("ranks")[0].as_py(), np.int32)
    doc_ids = row.column("doc_ids")[0].values
    held = {x["term"]: (np.frombuffer(x["docs"], np.int32), np.frombuffer(x["tfs"], np.int32)) for x in row.column("postings")[0].values.to_pylist()}
    here = {words[t]: k for k, t in enumerate(t for t in held if t in words)}
    shard = Strata(ms, ranks, [x for t, x in held.items() if t in words])
    items, places, scores = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for item, (terms, weights) in queries.items():
        known = [(here[t], w) for t, w in zip(terms, weights, strict=True) if t in here]
        if not known:
            continue
        place, score = shard.best(*(np.array(x) for x in zip(*known, strict=True)), best)
        items += [item] * len(place)
        places.append(place)
        scores.append(score)
    return pa.record_batch(
        [pa.array(items, pa.int64()), doc_ids.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(scores), pa.int64())],
        ["item", "doc_id", "score"],
    )


class Strata:
    """The postings of a shard by term, stratum and frequency, and what a stratum can score."""

    def __init__(self, ms: np.ndarray, ranks: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]]):
        """``postings``: places and frequencies, a pair a term."""
        values, first = np.unique(ms, return_index=True)
        self.sizes, self.ranks = np.diff(np.append(first, len(ms))), ranks
        self.docs = np.concatenate([np.zeros(0, np.int32), *(x[0] for x in postings)])
        tfs = np.concatenate([np.zeros(0, np.int64), *(x[1] for x in postings)]).astype(np.int64)
        strata = np.repeat(np.arange(len(values)), self.sizes)[self.docs]
        # impacts, once for each frequency of a stratum
        wide = int(tfs.max(initial=0)) + 1
        pairs, which = np.unique(strata * wide + tfs, return_inverse=True)
        tf, m = pairs % wide, values[pairs // wide]
        self.worth = ((1_000_000_000 * tf) // (1000 * tf + 20 * m))[which]
        # where each stratum of each term begins; its last posting has the largest frequency
        ends = np.cumsum([len(x[0]) for x in postings])
        key = np.repeat(np.arange(len(postings)), [len(x[0]) for x in postings]) * len(values) + strata
        cuts = np.searchsorted(key, np.arange(len(postings) * len(values) + 1)).astype(np.int32)
        self.cuts = cuts[:-1].reshape(len(postings), -1)
        self.lengths = np.diff(cuts).reshape(len(postings), -1)
        last = np.where(self.lengths > 0, self.cuts + self.lengths - 1, 0)
        self.top = np.where(self.lengths > 0, self.worth[last], 0) if len(ends) and ends[-1] else np.zeros_like(last)

    def best(self, terms: np.ndarray, weights: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the best documents, any order.

        Strata are visited by their bound, as many at a time as hold some multiple of
        ``count`` documents, twice as many each time.
        """
        bounds = (weights[:, None] * self.top[terms]).sum(0)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        reach = np.cumsum(self.sizes[order])
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, some = 0, 4 * count
        while at < len(order):
            upto = int(np.searchsorted(reach, (reach[at - 1] if at else 0) + some)) + 1
            visit = order[at:upto]
            if len(scores) >= count:
                visit = visit[bounds[visit] >= scores.min()]
                if not len(visit):
                    break
            at, some = upto, 2 * some
            starts, lengths = self.cuts[terms][:, visit].ravel(), self.lengths[terms][:, visit].ravel()
            into = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            found = np.zeros(len(self.ranks), np.int64)
            np.add.at(found, self.docs[into], self.worth[into] * np.repeat(np.repeat(weights, len(visit)), lengths))
            hit = np.flatnonzero(found)
            places, scores = np.concatenate([places, hit]), np.concatenate([scores, found[hit]])
            kept = np.lexsort((self.ranks[places], -scores))[:count]
            places, scores = places[kept], scores[kept]
        return places, scores
