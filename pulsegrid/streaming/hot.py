"""A hot table before the store, moved there by its size or when its stream is idle."""

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from pulsegrid.operators.hybrid import hot_cold_synthesis
from pulsegrid.schema import MESSAGES, QUARANTINE, message_columns
from pulsegrid.sources.messages import accepted, quarantined, read_messages
from pulsegrid.storage.layout import read_folder
from pulsegrid.storage.store import Store
from pulsegrid.streaming.ingest import numbered


class HotTable:
    """Messages of the batches that came after the last move, below ``folder``.

    A batch is written to a folder of its own, which a repeated batch replaces. A move
    appends all hot batches to the store as one batch with the id of the last of them;
    from its commit on they count as cold, so a move that is cut short is repeated and no
    message is in both or in none. Rows that cannot be read go to the store's quarantine with
    the move. ``moves`` lists why each move of this object took place.
    """

    def __init__(self, store: Store, folder: str, *, max_rows: int, idle_s: float, clock: Callable[[], float] = time.monotonic):
        self.store, self.folder = store, folder.rstrip("/")
        self.max_rows, self.idle_s, self._clock = max_rows, idle_s, clock
        self._since = clock()
        self.moves: list[str] = []

    def moved_to(self) -> int:
        """The last batch whose messages are cold, -1 before the first move."""
        last = self.store.commits().filter(F.col("stream_id") == self.store.stream_id)
        found = last.agg(F.max("batch_id")).first()[0]
        return -1 if found is None else found

    def messages(self, after: int | None = None) -> DataFrame:
        after = self.moved_to() if after is None else after
        rows = read_folder(self.store.spark, f"{self.folder}/hot", MESSAGES, "batch_id")
        return rows.filter(F.col("batch_id") > after).select(*message_columns())

    def synthesis(self, from_ms: int, to_ms: int) -> DataFrame:
        """Hot and cold messages of a range together."""
        return hot_cold_synthesis(self.messages(), self.store.messages(), from_ms, to_ms)

    def load(self, batch: DataFrame, batch_id: int, **parse_options) -> None:
        """A micro-batch, for ``foreachBatch``; moves when there are ``max_rows`` by then."""
        if batch_id <= self.moved_to():
            return
        read = read_messages(batch, **parse_options)
        quarantined(read).write.mode("overwrite").parquet(f"{self.folder}/bad/batch_id={batch_id}")
        rows = accepted(numbered(read, batch_id))
        rows.write.mode("overwrite").parquet(f"{self.folder}/hot/batch_id={batch_id}")
        self._since = self._clock()
        # One count from Parquet footers.
        if self.messages().count() >= self.max_rows:
            self.move("rows")

    def move(self, reason: str) -> bool:
        """Append the hot messages to the store; False if there are none."""
        after = self.moved_to()
        rows = read_folder(self.store.spark, f"{self.folder}/hot", MESSAGES, "batch_id").filter(F.col("batch_id") > after)
        last = rows.agg(F.max("batch_id")).first()[0]
        if last is None:
            return False
        bad = read_folder(self.store.spark, f"{self.folder}/bad", QUARANTINE, "batch_id")
        bad = bad.filter(F.col("batch_id").between(after + 1, last)).drop("batch_id")
        self.store.append(rows.select(*message_columns()), last, quarantine=bad, writer=f"hot table {self.folder}")
        self.moves.append(reason)
        return True

    def tick(self) -> bool:
        """Move if nothing has come for ``idle_s`` seconds."""
        if self._clock() - self._since < self.idle_s:
            return False
        self._since = self._clock()
        return self.move("idle")

    def start(self, raw: DataFrame, checkpoint: str, trigger: dict, **parse_options) -> StreamingQuery:
        """Feed the streaming table ``raw``; idle times come from the session's listener."""
        query = (
            raw.writeStream.foreachBatch(lambda batch, batch_id: self.load(batch, batch_id, **parse_options))
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )
        self._listener = _IdleListener(self, str(query.id))
        self.store.spark.streams.addListener(self._listener)
        return query

    def stop(self, query: StreamingQuery) -> None:
        query.stop()
        self.store.spark.streams.removeListener(self._listener)


class _IdleListener(StreamingQueryListener):
    def __init__(self, hot: HotTable, query_id: str):
        self._hot, self._query_id = hot, query_id

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if str(event.progress.id) == self._query_id and event.progress.numInputRows == 0:
            self._hot.tick()

    def onQueryIdle(self, event) -> None:
        if str(event.id) == self._query_id:
            self._hot.tick()

    def onQueryTerminated(self, event) -> None:
        pass
