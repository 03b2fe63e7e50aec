"""Substring deduplication by sliding spans of sentences.

Every run of several consecutive sentences is hashed; the runs of all documents meet by
hash; sentences in any but the first occurrence of a run are removed.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.batches import Batches, documents, map_batches
from pulsegrid.session import written

#: Consecutive sentences of a span.
SPAN = 3
#: A sentence ends with a stop, a question or exclamation mark before white space, or with
#: its line. Of every WINDOW words in one sentence the one with the least hash ends a piece,
#: so the same words are cut alike wherever they stand, and no piece is longer than WINDOW.
WINDOW = 10
#: Sentences or pieces of a span, and its words at least, for which every repeated passage of
#: over 50 words holds a span: two windows' edges, a piece, and the span. Two short sentences
#: that many texts have ("Yes. No.") are none.
FEW, WORDS = 2, 14

SPACE = np.array([chr(c).isspace() for c in range(0x3002)])
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
END, ALL = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


class Pieces(NamedTuple):
    """Sentences or pieces of them: first and last character, first and last word (ends
    excluded), and a hash of each word of the text."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    last: np.ndarray
    words: np.ndarray


def pieces(text: str) -> Pieces:
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    edges = np.flatnonzero(np.diff(SPACE[np.minimum(code, len(SPACE) - 1)], prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return Pieces(none, none, none, none, none.astype(np.uint64))
    words = np.array([xxhash.xxh3_64_intdigest(w) for w in text.lower().split()], np.uint64)
    stop = np.isin(code[ends - 1], [ord(c) for c in ".!?"])
    lines = np.cumsum(code == ord("\n"))
    stop[:-1] |= lines[starts[1:]] > lines[ends[:-1] - 1]
    stop[-1] = True
    cut = stop.copy()
    if n >= WINDOW:
        least, at = words[: n - WINDOW + 1].copy(), np.arange(n - WINDOW + 1)
        for i in range(1, WINDOW):
            other = words[i : n - WINDOW + 1 + i]
            at = np.where(other < least, np.arange(i, n - WINDOW + 1 + i), at)
            least = np.minimum(least, other)
        sentence = np.cumsum(stop) - stop
        cut[at[sentence[: n - WINDOW + 1] == sentence[WINDOW - 1 :]]] = True
    last = np.flatnonzero(cut)
    first = np.concatenate([[0], last[:-1] + 1])
    words[last] ^= END
    return Pieces(starts[first], ends[last], first, last + 1, words)


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence or piece; white space between them belongs to none."""
    found = pieces(text)
    return list(zip(found.starts.tolist(), found.ends.tolist(), strict=True))


def runs_of(found: Pieces, size: int = SPAN, words: int = 0, rest: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last piece of each run, and its 64-bit hash, white space and case aside.

    A run has ``size`` pieces and as many more as it takes to ``words`` words. With ``rest``
    the last pieces of a text always lie in a run: one counted from the end or, if the text
    is too short for that, the whole text, which meets whole texts only.
    """
    n = len(found.first)
    first = np.arange(n)
    last = np.maximum(first + size - 1, np.searchsorted(found.last, found.first + words))
    first, last = first[last < n], last[last < n]
    all_of_it = False
    if rest and n and (not len(last) or last[-1] < n - 1):
        start = min(n - size, int(np.searchsorted(found.first, found.last[-1] - words, side="right")) - 1)
        all_of_it = start < 0
        first, last = np.append(first, max(start, 0)), np.append(last, n - 1)
    begin, end = found.first[first], found.last[last]
    power, back = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(found.words), x, np.uint64)])) for x in (BASE, BACK))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(found.words * power[:-1])])
    value = (total[end] - total[begin]) * back[begin]
    value = (value ^ value >> np.uint64(32) ^ (end - begin).astype(np.uint64)) * np.uint64(BASE)
    value ^= value >> np.uint64(29)
    if all_of_it:
        value[-1] ^= ALL
    return first, last, value


def deduplicated(
    docs: DataFrame, size: int = SPAN, id_col: str = "doc_id", text_col: str = "text", words: int = 0, rest: bool = False
) -> DataFrame:
    """One row per document: doc_id, n_sentences, n_removed, text (what is left of it).

    A run's first occurrence is the one in the smallest doc_id, then at the smallest place;
    it stays unless another run covers it. Removed sentences go with the white space after
    them. Runs travel with a hash, an id and a place only; copies within one task are
    settled there, so a run that is everywhere sends one row a task. A null text is empty;
    documents without id neither remove nor lose anything; rows of equal id and text are one
    document, returned as often as they come; other columns are not looked at. Words need white space
    between them: a line without any is one word, and ids must cast to long. ``size``, ``words`` and ``rest``: see ``runs_of``; a run's place is its number.
    """
    source = documents(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    keyed = source.withColumn("key", F.xxhash64("text"))

    def runs(batches: Batches) -> Batches:
        seen: dict[int, tuple] = {}
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, key in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "key")), strict=True):
                if doc_id is None:
                    continue
                found = runs_of(pieces(text), size, words, rest)[2].astype(np.int64).tolist()
                for place, value in enumerate(found):
                    me = (doc_id, place, key)
                    known = seen.get(value)
                    if known is None:
                        if len(seen) > HELD:
                            seen.clear()
                        seen[value] = me
                        out.append((value, *me, None, None))
                    elif known != me:
                        # of two in one task the later one goes; the earlier one stands for both
                        first, later = (known, me) if known < me else (me, known)
                        seen[value] = first
                        if first is me:
                            out.append((value, *me, None, None))
                        out.append((None, None, None, None, later[0], (later[2], later[1])))
            yield _rows(out)

    schema = "run long, doc_id long, place int, key long, gone_id long, gone struct<key:long,place:int>"
    found = written(map_batches(keyed, runs, schema), "runs")
    sent = found.where("run IS NOT NULL").select("run", "doc_id", "place", "key")
    first = sent.groupBy("run").agg(F.min(F.struct("doc_id", "place", "key")).alias("first"), F.count("*").alias("n")).where("n > 1")
    known = written(first.select("run", "first"), "repeated")
    later = (
        sent.join(known, "run")
        .where(F.struct("doc_id", "place", "key") != F.col("first"))
        .select("doc_id", "key", "place")
        .unionByName(found.where("gone_id IS NOT NULL").select(F.col("gone_id").alias("doc_id"), "gone.key", "gone.place"))
    )
    per_document = written(
        later.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("place")).alias("places")), "places"
    )
    joined = keyed.join(per_document, ["doc_id", "key"], "left")

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            counts, removed, texts = [], [], []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                found = pieces(text)
                spans = list(zip(found.starts.tolist(), found.ends.tolist(), strict=True)) if places else []
                gone = _gone(found, places, size, words, rest) if places else set()
                counts.append(len(found.starts))
                removed.append(len(gone))
                texts.append(_without(text, spans, gone) if gone else text)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                ["doc_id", "n_sentences", "n_removed", "text"],
            )

    return map_batches(joined.select("doc_id", "text", "places"), cut, "doc_id long, n_sentences long, n_removed long, text string")


#: Runs a task remembers.
HELD = 1_000_000


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * 6
    gone = [None if x is None else {"key": x[0], "place": x[1]} for x in columns[5]]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.record_batch(
        [*(pa.array(c, k) for c, k in zip(columns[:5], kinds, strict=True)), pa.array(gone, pa.struct([("key", pa.int64()), ("place", pa.int32())]))],
        ["run", "doc_id", "place", "key", "gone_id", "gone"],
    )


def _gone(found: Pieces, places: list[int], size: int, words: int, rest: bool) -> set[int]:
    """Numbers of the pieces in the runs of these numbers."""
    first, last, _ = runs_of(found, size, words, rest)
    change = np.zeros(len(found.first) + 1, np.int64)
    np.add.at(change, first[places], 1)
    np.add.at(change, last[places] + 1, -1)
    return set(np.flatnonzero(np.cumsum(change)).tolist())


def _without(text: str, spans: list[tuple[int, int]], gone: set[int]) -> str:
    parts, at = [], 0
    for i, (start, _) in enumerate(spans):
        if i in gone:
            parts.append(text[at:start])
            at = spans[i + 1][0] if i + 1 < len(spans) else len(text)
    return "".join([*parts, text[at:]])
