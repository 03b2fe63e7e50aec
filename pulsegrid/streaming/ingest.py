"""Streaming ingest of JSON messages into a store."""

from collections.abc import Callable, Iterable
from contextlib import ExitStack

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.operators.identity import first_by_id
from pulsegrid.operators.joins import keys_fit_broadcast
from pulsegrid.schema import ARRIVAL
from pulsegrid.session import prepare
from pulsegrid.sources.messages import DUPLICATE_ID, accepted, quarantined, read_messages, wire_text
from pulsegrid.storage.store import Sink, Store

AVAILABLE_NOW = {"availableNow": True}
EVERY_5_SECONDS = {"processingTime": "5 seconds"}

# Low bits in which Spark's row ids count the rows of an input split; bits for the rows
# of a batch in ``seq``: 2^36 rows a batch and 2^27 batches a stream, beyond is an error.
SPLIT_BITS, BATCH_SHIFT = 33, 36


def text_stream(
    spark: SparkSession, folder: str, max_files: int | None = None, max_bytes: int | str | None = None
) -> DataFrame:
    """JSON lines appearing in ``folder``, at most ``max_files`` or about ``max_bytes`` per
    micro-batch. Beside ``raw`` it has the columns of ``ARRIVAL``."""
    reader = prepare(spark).readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    origin = [F.col(f"_metadata.{name}") for name in ("file_modification_time", "file_path", "file_block_start")]
    return reader.load(folder).select(
        F.col("value").alias("raw"), *(c.alias(name) for c, name in zip(origin, ARRIVAL, strict=True))
    )


def load_batch(
    store: Store,
    raw: DataFrame,
    batch_id: int,
    *,
    unique_ids: bool = False,
    also: Iterable[Sink] = (),
    writer: str | None = None,
    **parse_options,
) -> bool:
    """Parse ``raw`` and add it to ``store`` as one batch; ``seq`` numbers the arrivals of
    the whole stream.

    Rows arrive by ``ARRIVAL``: by the time their file was last changed, files of one time
    by path, and within a file by position. A ``raw`` without these columns arrives in the
    order of its input splits.

    With ``unique_ids`` only the first message of an id to arrive is stored, in this
    batch and against everything stored before, however the batches are cut; the
    others are quarantined. Duplicates go before the rollup is built, because
    partials cannot be un-merged. The ids stored before are looked up in the store's
    index of ids, which such batches keep.
    """
    # Spills to disk; a lost executor's part is read and parsed again. The text of good rows,
    # often most of a row, is not needed any more.
    read = read_messages(raw, require_id=unique_ids, **parse_options)
    text = F.when(F.col("reason").isNotNull(), F.col("raw"))
    with ExitStack() as held:
        read = _hold(read.withColumn("raw", text), held)
        good, bad = accepted(numbered(read, batch_id)), quarantined(read)
        if unique_ids:
            good, repeats = _split_repeats(store, good, held)
            bad = bad.unionByName(repeats)
        return store.append(good, batch_id, quarantine=bad, also=also, writer=writer)


def _hold(rows: DataFrame, held: ExitStack) -> DataFrame:
    """``rows`` persisted until ``held`` closes."""
    rows.persist(StorageLevel.MEMORY_AND_DISK)
    held.callback(rows.unpersist)
    return rows


def numbered(read: DataFrame, batch_id: int) -> DataFrame:
    """``seq`` made dense within the batch and put behind the batch id, so that it rises
    with arrival and is unique in the stream.

    Blocks, a row each, are counted and put in order; within a block Spark's row ids have
    no gaps, because one task reads it from end to end.
    """
    if batch_id >> (63 - BATCH_SHIFT):
        raise ValueError("batch id too large to be numbered")
    keys = [name for name in ARRIVAL if name in read.columns]
    if not keys:
        keys, read = ["block"], read.withColumn("block", F.shiftright("seq", SPLIT_BITS))
    blocks = read.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.min("seq").alias("_first"))
    before = F.sum("_rows").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0))
    fits = F.when(start + F.col("_rows") <= 1 << BATCH_SHIFT, start).otherwise(
        F.raise_error(F.lit("batch too large to be numbered")).cast("bigint")
    )
    starts = blocks.select(*keys, (F.lit(batch_id << BATCH_SHIFT) + fits - F.col("_first")).alias("_shift"))
    # A row a block of input, some 128 MiB: broadcast unless the backlog has too many.
    starts = F.broadcast(starts) if keys_fit_broadcast(starts) else starts
    return read.join(starts, keys).withColumn("seq", F.col("seq") + F.col("_shift")).drop("_shift")


def _split_repeats(store: Store, good: DataFrame, held: ExitStack) -> tuple[DataFrame, DataFrame]:
    """First arrivals of new ids, and the other rows as quarantine. ``seq`` tells rows apart,
    so what is not kept needs no comparison of whole rows."""
    # A look-up reads its probes up to six times, each a shuffle of the batch if they were not
    # kept; they are dropped as soon as its result is.
    firsts = _hold(first_by_id(good, ["seq"]), held)
    fresh = _hold(store.ids().unknown(firsts), held)
    fresh.count()
    firsts.unpersist()
    return fresh, good.join(fresh.select("seq"), "seq", "left_anti").select(
        wire_text().alias("raw"),
        F.lit(DUPLICATE_ID).alias("reason"),
        F.current_timestamp().alias("ingest_ts"),
    )


def start_ingest(
    store: Store,
    raw: DataFrame,
    checkpoint: str,
    *,
    trigger: dict = AVAILABLE_NOW,
    after_commit: Callable[[int], None] | None = None,
    **load_options,
) -> StreamingQuery:
    """Feed the streaming table ``raw`` into ``store``.

    ``AVAILABLE_NOW`` drains what has arrived and stops (replay, backfill,
    on-demand flush); ``EVERY_5_SECONDS`` keeps going. A batch repeated after a
    crash finds its commit row, or overwrites its own unfinished folders. Commits
    carry the id of the streaming query, which its checkpoint keeps: the same
    ``stream_id`` fed from another checkpoint is an error, so the store must have
    been given a ``stream_id``.
    ``after_commit`` gets the id of every batch, repeated ones included.
    """
    if not store.has_stream:
        raise ValueError("a store that a stream feeds needs a stream_id of its own")

    def load(batch: DataFrame, batch_id: int) -> None:
        writer = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        load_batch(store, batch, batch_id, writer=writer, **load_options)
        if after_commit is not None:
            after_commit(batch_id)

    return (
        raw.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def flush(store: Store, raw: DataFrame, checkpoint: str, **load_options) -> None:
    """Ingest everything that has arrived and wait for it."""
    start_ingest(store, raw, checkpoint, **load_options).awaitTermination()


def backlog_rows(store: Store, folder: str) -> int:
    """Lines in ``folder`` that the text stream feeding ``store`` has not committed yet, by
    what its commits say they were given. Lines must stay in the folder."""
    try:
        lines = store.spark.read.text(folder).count()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = 0
    return lines - store.arrived()
