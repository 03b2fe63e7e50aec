"""Exact substring deduplication: Burrows-Wheeler transforms of texts that share an anchor.

Two documents can only share a string of LENGTH bytes if they share its anchor, the window
of ANCHOR bytes with the least hash in it. Anchors meet by hash; an occurrence whose whole
surroundings equal those in an earlier document is settled at once. Where an anchor has
several different surroundings, these are put into one text; intervals of its
Burrows-Wheeler transform are extended backwards, breadth first, so that common prefixes
come by increasing length and the intervals left at LENGTH are the repeated strings.
"""

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.batches import Batches, documents, map_batches, small
from pulsegrid.session import written

#: Bytes of a repeated string and of an anchor, and so of what surrounds an anchor a side.
LENGTH, ANCHOR = 50, 20
SIDE = LENGTH - ANCHOR
#: Bytes of documents hashed together, and string starts of a very long document at a time.
BLOCK, PIECE = 1 << 19, 8 << 20
#: Anchors a task gathers before it sends them, and hash ranges they are sent to.
GATHER, RANGES = 1 << 18, 1024
#: Bytes of surroundings in one transform; surroundings of one anchor from which on they
#: are dealt to several transforms; symbols by which suffixes are sorted.
TEXT, CROWD, SORTED = 1 << 20, 10_000, 14

_rng = np.random.default_rng(20)
LETTERS = _rng.integers(1, 1 << 63, 256, np.uint64)
FACTORS = _rng.integers(1, 1 << 63, 8, np.uint64) | np.uint64(1)
LOW48 = np.uint64((1 << 48) - 1)


def _powers(data: np.ndarray, most: int) -> list[np.ndarray]:
    """Hashes of the 2^j bytes from each place on, for 2^j <= most."""
    out = [LETTERS[data]]
    while 1 << len(out) <= most:
        j, half = len(out) - 1, out[-1]
        n = max(len(data) - (2 << j) + 1, 0)
        both = half[:n] * FACTORS[j]
        both += half[1 << j : (1 << j) + n]
        both ^= both >> np.uint64(31)
        out.append(both)
    return out


def _hash_at(powers: list[np.ndarray], places: np.ndarray, length: int) -> np.ndarray:
    """Hash of ``length`` bytes from each of ``places`` on."""
    total = np.full(len(places), length, np.uint64)
    at = places
    for j in range(length.bit_length() - 1, -1, -1):
        if length >> j & 1:
            total = (total ^ powers[j][at]) * FACTORS[7]
            total ^= total >> np.uint64(29)
            at = at + (1 << j)
    return total


def _places(powers: list[np.ndarray]) -> np.ndarray:
    """For each string of LENGTH bytes the place of its anchor."""
    long = len(powers[0])
    n = long - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if long > 1 << 24:
        raise ValueError(f"{long} bytes at once: a place has 24 bits")
    width = SIDE + 1
    every = np.arange(long - ANCHOR + 1)
    bits = np.uint64((1 << 24) - 1)
    # of equal hashes the first counts: the place is the tie break
    key = _hash_at(powers, every, ANCHOR) & ~bits
    key |= every.astype(np.uint64)
    least, span = key, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[width - span : width - span + n])
    return (least & bits).astype(np.int64)


def anchors(powers: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of the anchors of the strings that start in each [start, end)."""
    place = _places(powers)
    if not len(place):
        return place
    inside = np.zeros(len(powers[0]) + 1, np.int32)
    fit = ends > starts
    np.add.at(inside, starts[fit], 1)
    np.add.at(inside, ends[fit], -1)
    place = place[np.cumsum(inside)[: len(place)] > 0]
    return place[np.flatnonzero(np.diff(place, prepend=-1))]


class Gathered:
    """Anchors of many documents as columns: anchor hash, hash of the surroundings, document
    (id and tie), place. Documents are hashed BLOCK bytes at a time."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.pieces: list[tuple] = []
        self.bytes = self.n = 0

    def add(self, doc_id: int, tie: int, data: bytes) -> None:
        strings = len(data) - LENGTH + 1
        for at in range(0, max(strings, 0), PIECE):
            begin, end = max(at - SIDE, 0), min(at + PIECE + 2 * LENGTH, len(data))
            self.pieces.append((doc_id, tie, data[begin:end], begin, at - begin, min(PIECE, strings - at), len(data)))
            self.bytes += end - begin
            if self.bytes >= BLOCK:
                self.close()

    def close(self) -> None:
        if not self.pieces:
            return
        ids, ties, texts, begins, froms, counts, totals = (list(x) for x in zip(*self.pieces, strict=True))
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        powers = _powers(data, LENGTH + SIDE)
        firsts = starts + froms
        place = anchors(powers, firsts, firsts + counts)
        which = np.searchsorted(ends, place, side="right")
        own = place - starts[which] + np.array(begins)[which]
        full = (own >= SIDE) & (own + LENGTH <= np.array(totals)[which])
        around = np.empty(len(place), np.uint64)
        around[full] = _hash_at(powers, place[full] - SIDE, LENGTH + SIDE)
        for i in np.flatnonzero(~full):
            left = min(int(own[i]), SIDE)
            piece = data[place[i] - left : min(place[i] + LENGTH, ends[which[i]])]
            around[i] = xxhash.xxh3_64_intdigest(piece.tobytes(), seed=left + 1)
        self.parts.append((_hash_at(powers, place, ANCHOR), around & LOW48, np.array(ids, np.int64)[which], np.array(ties, np.int32)[which], own))
        self.n += len(place)
        self.pieces, self.bytes = [], 0

    def columns(self) -> list[np.ndarray]:
        self.close()
        kinds = (np.uint64, np.uint64, np.int64, np.int32, np.int64)
        parts, self.parts, self.n = self.parts, [], 0
        return [np.concatenate([np.zeros(0, k), *(p[i] for p in parts)]) for i, k in enumerate(kinds)]


def _settle(h, c, d, t, p) -> tuple:
    """Sort by anchor, surroundings and document; split off what an earlier document has with
    the same surroundings. Returns the sorted columns and which rows are settled."""
    order = np.lexsort((p, t, d, c, h))
    h, c, d, t, p = h[order], c[order], d[order], t[order], p[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    least = d[new][np.cumsum(new) - 1] if len(h) else d
    return h, c, d, t, p, d > least


def _spans_of(d, t, p) -> list[tuple[int, int, bytes]]:
    """(doc_id, tie, places of settled anchors as bytes) for each document."""
    if not len(d):
        return []
    order = np.lexsort((p, t, d))
    d, t, p = d[order], t[order], p[order]
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])]))
    return [(int(d[s]), int(t[s]), p[s:e].astype("<i8").tobytes()) for s, e in zip(new, [*new[1:], len(d)], strict=True)]


SENT = "part long, pack binary, doc_id long, tie int, places binary"
MARKS = "doc_id long, tie int, kind int, anchor long, around long, crowd int, places binary"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "pack", "doc_id", "tie", "places"])


def _marks(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 7
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    names = ["doc_id", "tie", "kind", "anchor", "around", "crowd", "places"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _meet(source: DataFrame) -> DataFrame:
    """Rows of kind 0: places of a document's anchors with surroundings an earlier document
    has too. Rows of kind 1: places of an anchor with surroundings to be compared."""
    ranges = max(RANGES, 8 * int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def send(batches: Batches) -> Batches:
        held = Gathered()

        def packed() -> pa.RecordBatch:
            h, c, d, t, p, settled = _settle(*held.columns())
            rows = [(i % ranges, None, i, j, data) for i, j, data in _spans_of(d[settled], t[settled], p[settled])]
            part = (h[~settled] >> np.uint64(48)).astype(np.int64) % ranges
            columns = [x[~settled] for x in (h, c, d, t, p)]
            # by document and place within a range: small steps, which pack well
            order = np.lexsort((columns[4], columns[3], columns[2], part))
            part = part[order]
            h, c, d, t, p = (x[order] for x in columns)
            new = np.flatnonzero(np.diff(part, prepend=-1))
            packer = zstandard.ZstdCompressor(level=1)
            for s, e in zip(new.tolist(), [*new[1:].tolist(), len(part)][: len(new)], strict=True):
                data = b"".join(
                    [np.array([e - s], "<i8").tobytes(), _six(h[s:e] & LOW48), _six(c[s:e]), np.diff(d[s:e], prepend=0).astype("<i8").tobytes(),
                     t[s:e].astype("<i4").tobytes(), p[s:e].astype("<i8").tobytes()]
                )
                rows.append((int(part[s]), packer.compress(data), None, None, None))
            return _sent(rows)

        for batch in batches:
            for doc_id, tie, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tie", "text")), strict=True):
                held.add(doc_id, tie, text)
                if held.n >= GATHER:
                    yield packed()
        yield packed()

    def gather(batches: Batches) -> Batches:
        parts: list[list] = [[] for _ in range(5)]
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for part, pack, doc_id, tie, places in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if pack is None:
                    rows.append((doc_id, tie, 0, None, None, None, places))
                    continue
                data = unpacker.decompress(pack)
                n = int(np.frombuffer(data, "<i8", 1)[0])
                high = np.full(n, part << 48 & (1 << 63) - 1, np.uint64)
                at = 8
                for i, x in enumerate((_from_six(data, at, n) | high, _from_six(data, at + 6 * n, n))):
                    parts[i].append(x)
                at += 12 * n
                parts[2].append(np.cumsum(np.frombuffer(data, "<i8", n, at)))
                parts[3].append(np.frombuffer(data, "<i4", n, at + 8 * n))
                parts[4].append(np.frombuffer(data, "<i8", n, at + 12 * n))
            yield _marks(rows)
        if not parts[0]:
            return
        h, c, d, t, p, settled = _settle(*(np.concatenate(x) for x in parts))
        parts.clear()
        yield _marks([(i, j, 0, None, None, None, data) for i, j, data in _spans_of(d[settled], t[settled], p[settled])])
        h, c, d, t, p = (x[~settled] for x in (h, c, d, t, p))
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        several = np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)
        crowd = np.diff(np.append(starts, len(h)))
        wanted = np.repeat(several, crowd)
        h, c, d, t, p, crowd = h[wanted], c[wanted], d[wanted], t[wanted], p[wanted], np.repeat(crowd, crowd)[wanted]
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1]) | (t[1:] != t[:-1])])) if len(h) else []
        rows = []
        for s, e in zip(new, [*new[1:], len(h)][: len(new)], strict=True):
            rows.append((int(d[s]), int(t[s]), 1, int(h[s]), int(c[s]), int(crowd[s]), p[s:e].astype("<i8").tobytes()))
            if len(rows) >= 20_000:
                yield _marks(rows)
                rows = []
        yield _marks(rows)

    sent = map_batches(source.select("doc_id", "tie", F.col("text").cast("binary").alias("text")), send, SENT)
    return written(map_batches(sent.repartition("part"), gather, MARKS), "marks")


def _six(values: np.ndarray) -> bytes:
    return (values & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (values >> np.uint64(32)).astype("<u2").tobytes()


def _from_six(data: bytes, at: int, n: int) -> np.ndarray:
    high = np.frombuffer(data, "<u2", n, at + 4 * n).astype(np.uint64)
    return np.frombuffer(data, "<u4", n, at).astype(np.uint64) | high << np.uint64(32)


def _suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols (0 to 256), by doubling from seven."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(7, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = key << np.uint64(9) | padded[i : i + n]
    known = 7
    while True:
        order = np.argsort(key, kind="stable")
        if known >= depth:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0])).astype(np.uint64)
        after = np.zeros(n, np.uint64)
        after[: n - known] = rank[known:] + np.uint64(1)
        key = rank << np.uint64(32) | after
        known *= 2


def repeated(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings of ``length`` bytes that start at least twice in ``texts``: for each such
    start its interval's number, its text and its place in it.

    The order of suffixes looks at SORTED symbols only: what is equal so far may stand in
    any order, as an interval holds it whichever it is.

    The transform of the texts, a separator after each, gives a row for every suffix and
    the byte before it. Rows where a string may end form the first interval, of the empty
    prefix; extending all intervals by the byte before their rows makes the common prefix
    one longer. An interval left with one row is dropped.
    """
    sizes = np.array([len(t) for t in texts])
    symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + 1
    ends = np.cumsum(sizes + 1) - 1
    symbols[ends] = 0
    n = len(symbols)
    order = _suffix_order(symbols, SORTED)
    row_of = np.empty(n, np.int64)
    row_of[order] = np.arange(n)
    before = np.concatenate([symbols[-1:], symbols[:-1]])[order]  # the transform
    onward = row_of[(order - 1) % n]  # the row of the suffix one longer
    which = np.repeat(np.arange(len(texts)), sizes + 1)
    offset = np.arange(n) - np.repeat(ends - sizes, sizes + 1)
    rows = np.sort(row_of[(offset >= length)])
    interval = np.zeros(len(rows), np.int64)
    for _ in range(length):
        symbol = before[rows]
        # rows are in order of their interval: a stable sort by byte puts each extension together
        by = np.argsort(symbol, kind="stable")
        rows, interval, symbol = onward[rows[by]], interval[by], symbol[by]
        new = np.ones(len(rows), bool)
        new[1:] = (interval[1:] != interval[:-1]) | (symbol[1:] != symbol[:-1])
        alone = new & np.append(new[1:], True)
        interval = np.cumsum(new)
        rows, interval = rows[~alone], interval[~alone]
        if not len(rows):
            break
    start = order[rows]
    return interval, which[start], offset[start]


def _own_strings(surroundings: list[bytes], anchors_at: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Surroundings cut down to the strings whose anchor is the one they stand for, and how
    many bytes were cut off in front. Equal strings have equal anchors, so each is looked at
    in one group of surroundings only. About BLOCK bytes are looked at together."""
    sizes = np.array([len(x) for x in surroundings], np.int64)
    block = (np.cumsum(sizes) - sizes) // BLOCK
    edges = [*np.flatnonzero(np.diff(block, prepend=-1)).tolist(), len(sizes)]
    cut, front = [], [np.zeros(0, np.int64)]
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        own, off = _own_in_block(surroundings[s:e], anchors_at[s:e])
        cut += own
        front.append(off)
    return cut, np.concatenate(front)


def _own_in_block(surroundings: list[bytes], anchors_at: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    data = np.frombuffer(b"".join(surroundings), np.uint8)
    ends = np.cumsum([len(x) for x in surroundings])
    starts = ends - [len(x) for x in surroundings]
    place = _places(_powers(data, ANCHOR))
    which = np.repeat(np.arange(len(surroundings)), ends - starts)[: len(place)]
    inside = np.arange(len(place)) + LENGTH <= ends[which]
    own = np.flatnonzero(inside & (place == (starts + anchors_at)[which]))
    first = np.full(len(surroundings), len(data), np.int64)
    last = np.full(len(surroundings), -1, np.int64)
    np.minimum.at(first, which[own], own)
    np.maximum.at(last, which[own], own)
    cut = [data[f : e + LENGTH].tobytes() if e >= 0 else b"" for f, e in zip(first.tolist(), last.tolist(), strict=True)]
    return cut, np.where(last >= 0, first - starts, 0)


def _compare(surroundings: list[bytes], doc_of: np.ndarray) -> dict[int, np.ndarray]:
    """For surroundings, by number, the starts in it of strings that also start in those of
    an earlier document."""
    interval, which, offset = repeated(surroundings, LENGTH)
    if not len(interval):
        return {}
    new = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
    least = np.repeat(np.minimum.reduceat(doc_of[which], new), np.diff(np.append(new, len(interval))))
    later = doc_of[which] > least
    which, offset = which[later], offset[later]
    order = np.lexsort((offset, which))
    which, offset = which[order], offset[order]
    new = np.flatnonzero(np.diff(which, prepend=-1))
    return dict(zip(which[new].tolist(), np.split(offset, new[1:]), strict=True)) if len(new) else {}


def _reduced(surroundings: list[bytes], doc_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each string start in surroundings: its surroundings' number, its place there, the
    number of a start with the same string, and whether an earlier document has the string."""
    counts = np.array([len(x) - LENGTH + 1 for x in surroundings])
    base = np.cumsum(counts) - counts
    which = np.repeat(np.arange(len(surroundings)), counts)
    offset = np.arange(len(which)) - base[which]
    same = np.arange(len(which))
    interval, twice, at = repeated(surroundings, LENGTH)
    if len(interval):
        start = base[twice] + at
        new = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
        same[start] = np.repeat(np.minimum.reduceat(start, new), np.diff(np.append(new, len(interval))))
    least = np.full(len(which), np.iinfo(np.int64).max)
    np.minimum.at(least, same, doc_of[which])
    return which, offset, same, doc_of[which] > least[same]


def _borders(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows doc_id, tie, places: starts of strings that the comparison of surroundings finds.

    Surroundings are cut to their own strings before they are sent. Those of an anchor with
    more than CROWD of them are dealt evenly; each transform of about TEXT bytes of them
    leaves the smallest doc_id of each of its strings, and these are compared by string.
    """
    wanted = marks.where("kind = 1").groupBy("doc_id", "tie").agg(F.collect_list(F.struct("anchor", "around", "crowd", "places")).alias("wanted"))
    names = ("anchor", "deal", "doc_id", "tie", "begins", "data")
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())

    def cut(batches: Batches) -> Batches:
        unpacker = zstandard.ZstdDecompressor()
        held: list[tuple] = []
        size = 0

        def packed_rows() -> pa.RecordBatch:
            own, front = _own_strings([x[4] for x in held], np.array([x[5] for x in held], np.int64))
            rows = [
                (anchor, -1 if parts == 1 else xxhash.xxh3_64_intdigest(data) % parts, doc_id, tie, (begins + off).astype("<i8").tobytes(), string)
                for (anchor, parts, doc_id, tie, data, _, begins), string, off in zip(held, own, front.tolist(), strict=True)
                if string
            ]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))

        for batch in batches:
            for doc_id, tie, packed, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tie", "packed", "wanted")), strict=True):
                text = unpacker.decompress(packed)
                for w in wanted:
                    places = np.frombuffer(w["places"], "<i8")
                    begins = np.maximum(places - SIDE, 0)
                    data = text[begins[0] : places[0] + LENGTH]
                    held.append((w["anchor"], -(-w["crowd"] // CROWD), doc_id, tie, data, int(places[0] - begins[0]), begins))
                    size += len(data)
                    if size >= BLOCK:
                        yield packed_rows()
                        held, size = [], 0
        yield packed_rows()

    def search(batches: Batches) -> Batches:
        held: list[tuple] = []
        size, last, crowded = 0, None, False

        def found() -> pa.RecordBatch:
            rows = []
            if held and crowded:
                rows = strings_left()
            elif held:
                for i, own in _compare([x[3] for x in held], np.array([x[0] for x in held])).items():
                    doc_id, tie, begins = held[i][:3]
                    places = (np.frombuffer(begins, "<i8")[:, None] + own).ravel()
                    rows.append((doc_id, tie, places.astype("<i8").tobytes(), None))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            return pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "tie", "places", "string"]
            )

        def strings_left() -> list[tuple]:
            which, offset, same, later = _reduced([x[3] for x in held], np.array([x[0] for x in held]))
            # what an earlier document has goes; the others, a document's equal strings in one row, are compared further
            gone: dict[tuple, list] = {}
            for i, k, n, away in zip(which.tolist(), offset.tolist(), same.tolist(), later.tolist(), strict=True):
                doc_id, tie, begins, data = held[i]
                gone.setdefault((doc_id, tie, None if away else n), []).append(np.frombuffer(begins, "<i8") + k)
            return [
                (doc_id, tie, np.concatenate(places).astype("<i8").tobytes(), None if n is None else held[which[n]][3][offset[n] : offset[n] + LENGTH])
                for (doc_id, tie, n), places in gone.items()
            ]

        for batch in batches:
            for anchor, deal, doc_id, tie, begins, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # a crowd's strings are compared once more, so its transforms may end anywhere
                if held and (crowded != (deal >= 0) or size >= TEXT and (crowded or (anchor, deal) != last)):
                    yield found()
                    held, size = [], 0
                last, crowded = (anchor, deal), deal >= 0
                held.append((doc_id, tie, begins, data))
                size += len(data)
        yield found()

    asked = texts.join(wanted, ["doc_id", "tie"])
    schema = "anchor long, deal int, doc_id long, tie int, begins binary, data binary"
    dealt = map_batches(asked.select("doc_id", "tie", "packed", "wanted"), cut, schema).repartition("anchor", "deal")
    met = written(map_batches(dealt.sortWithinPartitions("anchor", "deal"), search, "doc_id long, tie int, places binary, string binary"), "borders")
    here, left = (met.where(x).select("doc_id", "tie", "places", *more) for x, more in (("string IS NULL", ()), ("string IS NOT NULL", ("string",))))
    if left.isEmpty():
        return here
    first = left.groupBy("string").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("string", "first")
    return here.unionByName(left.join(first, "string").where("doc_id > first").select("doc_id", "tie", "places"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (binary).

    A byte goes when a string of LENGTH bytes covers it that also starts in a document with
    a smaller doc_id, both judged on the input; spans are maximal removed stretches. A null
    text is empty; documents without id neither remove nor lose anything; rows that repeat
    an id do not count against each other; other columns are not looked at. A surroundings'
    equality is judged by 58 + 48 bits of hash.
    """
    source = documents(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    twice = written(source.groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1").select("doc_id"), "twice")
    keyed = source.withColumn("tie", F.lit(0))
    if not twice.isEmpty():
        hard = source.join(small(twice), "doc_id").select("doc_id", F.xxhash64("text").alias("key")).distinct()
        ties = written(hard.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("key"))), "ties")
        keyed = source.withColumn("key", F.xxhash64("text")).join(small(ties), ["doc_id", "key"], "left").select(
            "doc_id", F.coalesce("number", F.lit(0)).alias("tie"), "text"
        )

    def pack(batches: Batches) -> Batches:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [packer.compress(x) for x in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("tie"), pa.array(packed, pa.binary())], ["doc_id", "tie", "packed"])

    texts = map_batches(keyed.select("doc_id", "tie", F.col("text").cast("binary").alias("text")), pack, "doc_id long, tie int, packed binary")
    known = keyed.where("doc_id IS NOT NULL")
    marks = _meet(known.dropDuplicates(["doc_id", "tie"]) if not twice.isEmpty() else known)
    borders = _borders(texts, marks)
    gone = (
        marks.where("kind = 0").select("doc_id", "tie", "places", F.lit(SIDE).alias("side"))
        .unionByName(borders.select("doc_id", "tie", "places", F.lit(0).alias("side")))
        .groupBy("doc_id", "tie")
        .agg(F.collect_list(F.struct("places", "side")).alias("gone"))
    )

    def cut(batches: Batches) -> Batches:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for packed, gone in zip(batch.column("packed").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                text = unpacker.decompress(packed)
                rows.append((len(text), *_kept(text, gone or [])))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    joined = texts.join(gone, ["doc_id", "tie"], "left").select("packed", "gone", "doc_id")
    return map_batches(joined, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _kept(text: bytes, gone: list) -> tuple[int, int, bytes]:
    if not gone:
        return 0, 0, text
    change = np.zeros(len(text) + 1, np.int32)
    for part in gone:
        places = np.frombuffer(part["places"], "<i8")
        np.add.at(change, np.maximum(places - part["side"], 0), 1)
        np.add.at(change, np.minimum(places + LENGTH, len(text)), -1)
    away = np.cumsum(change[:-1]) > 0
    spans = int(away[0]) + int((away[1:] & ~away[:-1]).sum())
    return int(away.sum()), spans, np.frombuffer(text, np.uint8)[~away].tobytes()
