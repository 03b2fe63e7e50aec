"""Token ids in shard files that are wavelet matrices.

A shard holds the ids of consecutive documents, plane by plane: the highest bit of every
id, then the next one with the ids stably parted by the bits before, and so on. Planes are
cut into blocks, each compressed by itself and preceded by the number of ones before it, so
a reader can fetch one id, count an id in a range, or find its k-th occurrence from a few
blocks of one file, or take all ids back at once.
"""

import json
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pulsegrid.llm.batches import Batches, documents, map_batches
from pulsegrid.llm.bpe import encoder

MAGIC = b"PGWM1\0\0\0"
#: Id that ends each document; ids of a shard (its last document is never cut); bits of a block.
END_ID, SHARD_IDS, BLOCK_BITS = 2, 1 << 20, 1 << 18
#: Stretches of text a worker remembers the ids of; it holds little else.
MEMO_STRETCHES = 800_000


def build_shard(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """One file: magic, length of the header, header (JSON), document table, blocks."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    packer = zstandard.ZstdCompressor(level=1)
    blocks, planes = [], []
    row = ids.astype(np.uint16 if top <= 16 else np.uint32)
    for level in range(top - 1, -1, -1):
        bits = (row >> level & 1).astype(bool)
        ones, starts = 0, []
        for at in range(0, len(bits), BLOCK_BITS):
            part = bits[at : at + BLOCK_BITS]
            starts.append((ones, len(blocks)))
            ones += int(part.sum())
            blocks.append(packer.compress(np.packbits(part).tobytes()))
        planes.append({"level": level, "zeros": len(bits) - ones, "blocks": starts})
        row = np.concatenate([row[np.flatnonzero(~bits)], row[np.flatnonzero(bits)]])
    table = packer.compress(
        np.array([d or 0 for d in doc_ids], "<i8").tobytes()
        + np.array([d is None for d in doc_ids], "u1").tobytes()
        + np.array(lengths, "<i8").tobytes()
    )
    header = json.dumps(
        {"ids": len(ids), "documents": len(doc_ids), "table": len(table), "planes": planes, "sizes": [len(b) for b in blocks]}
    ).encode()
    return b"".join([MAGIC, struct.pack("<Q", len(header)), header, table, *blocks])


class Shard:
    """Reads a shard file; blocks are unpacked when they are needed."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard file")
        (size,) = struct.unpack_from("<Q", data, 8)
        header = json.loads(data[16 : 16 + size])
        self.n, self.planes = header["ids"], header["planes"]
        at = 16 + size
        raw = zstandard.ZstdDecompressor().decompress(data[at : at + header["table"]])
        count = header["documents"]
        null = np.frombuffer(raw, "u1", count, 8 * count)
        self.doc_ids = [None if x else d for d, x in zip(np.frombuffer(raw, "<i8", count).tolist(), null, strict=True)]
        self.lengths = np.frombuffer(raw, "<i8", count, 9 * count)
        self.places = at + header["table"] + np.concatenate([[0], np.cumsum(header["sizes"])]).astype(int)
        self.data = data
        self.bits = lru_cache(64)(self._bits)

    def _bits(self, block: int, count: int) -> np.ndarray:
        packed = zstandard.ZstdDecompressor().decompress(self.data[self.places[block] : self.places[block + 1]])
        return np.unpackbits(np.frombuffer(packed, np.uint8), count=count).view(bool)

    def _block(self, plane: dict, k: int) -> np.ndarray:
        return self.bits(plane["blocks"][k][1], min(BLOCK_BITS, self.n - k * BLOCK_BITS))

    def _ones(self, plane: dict, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i >= self.n:
            return self.n - plane["zeros"]
        k = i // BLOCK_BITS
        return plane["blocks"][k][0] + int(self._block(plane, k)[: i % BLOCK_BITS].sum())

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for plane in self.planes:
            ones = self._ones(plane, i)
            if self._block(plane, i // BLOCK_BITS)[i % BLOCK_BITS]:
                value |= 1 << plane["level"]
                i = plane["zeros"] + ones
            else:
                i -= ones
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` among the first i ids end up: start, end."""
        start = 0
        for plane in self.planes:
            if value >> plane["level"] & 1:
                start, i = (plane["zeros"] + self._ones(plane, x) for x in (start, i))
            else:
                start, i = (x - self._ones(plane, x) for x in (start, i))
        return start, i

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id among places start to end."""
        if value < 0 or value >> len(self.planes):
            return 0
        (a, b), (_, c) = self._range(value, start), self._range(value, self.n if end is None else end)
        return (c - a) - (b - a)

    def select(self, value: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of an id, or -1."""
        if value < 0 or value >> len(self.planes):
            return -1
        start, end = self._range(value, self.n)
        if k < 0 or start + k >= end:
            return -1
        place = start + k
        for plane in reversed(self.planes):
            one = bool(value >> plane["level"] & 1)
            place = self._find(plane, one, place - plane["zeros"] if one else place)
        return place

    def _find(self, plane: dict, one: bool, k: int) -> int:
        """The place of the k-th (from 0) one or zero of a plane."""
        before = [b[0] if one else j * BLOCK_BITS - b[0] for j, b in enumerate(plane["blocks"])]
        j = int(np.searchsorted(before, k, side="right")) - 1
        return j * BLOCK_BITS + int(np.flatnonzero(self._block(plane, j) == one)[k - before[j]])

    def ids(self) -> np.ndarray:
        """All ids: the planes undone from the lowest bit up."""
        row = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for plane in reversed(self.planes):
            bits = np.concatenate([self._bits(b[1], min(BLOCK_BITS, self.n - k * BLOCK_BITS)) for k, b in enumerate(plane["blocks"])])
            above = np.empty_like(row)
            above[np.flatnonzero(~bits)] = row[: plane["zeros"]]
            above[np.flatnonzero(bits)] = row[plane["zeros"] :] | row.dtype.type(1 << plane["level"])
            row = above
        return row


def write_shards(
    docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode ``docs`` and write shards in ascending order of (doc_id, text) to ``path``.

    The container is a Parquet table of part, shard, n_ids and file, one shard file in each
    Parquet file, so any store Spark reaches will do and a lost task writes its files anew.
    Null ids come first; a null text is empty and still gets its end id; repeated rows are
    each written; other columns are not looked at. One shuffle, by ranges of doc_id.
    """
    source = documents(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    end = np.array([end_id], "<u4").tobytes()

    def task(batches: Batches) -> Batches:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        coder = encoder(vocabulary, MEMO_STRETCHES)
        held: list[bytes] = []
        doc_ids: list[int | None] = []
        total = 0

        def closed() -> pa.RecordBatch:
            lengths = [len(x) // 4 for x in held]
            data = build_shard(np.frombuffer(b"".join(held), "<u4"), doc_ids, lengths)
            return pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([sum(lengths)], pa.int64()), pa.array([data], pa.binary())],
                ["part", "shard", "n_ids", "file"],
            )

        for batch in batches:
            coded = coder.batches_of(batch.column("text").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coded, strict=True):
                held.append(ids + end)
                doc_ids.append(doc_id)
                total += len(ids) // 4 + 1
                if total >= shard_ids:
                    yield closed()
                    held, doc_ids, total, shard = [], [], 0, shard + 1
        if held:
            yield closed()
        coder.forget()

    dealt = source.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    shards = map_batches(dealt, task, "part int, shard int, n_ids long, file binary")
    shards.write.option("maxRecordsPerFile", 1).option("compression", "uncompressed").parquet(path)


def read_documents(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every
    document, from the shard files at ``path``."""
    shards = spark.read.schema("part int, shard int, n_ids long, file binary").parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row a writing task
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    part_starts = parts.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))
    in_part = F.sum("n_ids").over(
        Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        shards.select("part", "shard", F.coalesce(in_part, F.lit(0)).alias("in_part"))
        .join(part_starts, "part")
        .select("part", "shard", (F.col("part_start") + F.col("in_part")).alias("start"))
    )

    def task(batches: Batches) -> Batches:
        for batch in batches:
            for data, start in zip(batch.column("file"), batch.column("start").to_pylist(), strict=True):
                shard = Shard(data.as_py())
                ids = shard.ids().astype("<u4").tobytes()
                ends = np.cumsum(shard.lengths)
                begins = ends - shard.lengths
                sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(begins + start, pa.int64()), pa.array(shard.lengths, pa.int64()), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    placed = shards.select("part", "shard", "file").join(F.broadcast(starts), ["part", "shard"])  # 20 bytes a shard
    return map_batches(placed.select("file", "start"), task, "doc_id long, start long, n_tokens long, ids_crc32 long")
