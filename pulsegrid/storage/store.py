"""Messages and their one-second rollup on Parquet.

Writing. A batch overwrites its own folders ``stream_id=S/batch_id=N`` in
``messages``, ``rollup_1s`` and ``ids`` and then commits with a row in ``commits``. A
batch without that row is invisible, so the tables always agree and repeating a
batch is harmless. Late rows are just further rows and further partials.

Sealing. ``seal`` rewrites days before a horizon, sorted and merged, with rollups of a
minute, an hour and a day beside those of a second, into ``sealed_*`` under a new generation and publishes it with a row in ``seals``.
Only days with unsealed rows are rewritten. From then on batch rows of those
days are superseded; folders no reader needs are listed by ``superseded``.

One writer per ``stream_id`` and one sealer at a time. Batch ids need not rise: sealing
keeps the ranges of ids it has taken in. A commit names its writer (a streaming query's
id, which lives in its checkpoint); another writer's batch of the same id is an error,
never a repetition.
"""

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime, timedelta, timezone
from typing import Literal, NamedTuple

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pulsegrid.functions.timeaxis import MS_PER_HOUR
from pulsegrid.operators.filters import closed_range
from pulsegrid.operators.hybrid import BLOCK_SECONDS, edge_partials, fewest_blocks, hybrid_partials, in_ranges
from pulsegrid.operators.joins import keys_fit_broadcast, measure, semi_join
from pulsegrid.operators.requests import synthesis_requests
from pulsegrid.operators.synthesis import merge_partials, rollup, synthesis_of
from pulsegrid.schema import PARTIAL_VALUES, message_columns
from pulsegrid.session import prepare
from pulsegrid.storage.ids import COLUMNS as ID_COLUMNS, Ids, indexed
from pulsegrid.storage.layout import Folders, overwrite, read_table

Sink = Callable[[DataFrame, int], None]

SORT_BY = {"time": ["ts_ms", "seq"], "sensor": ["sensor_type", "ts_ms", "seq"]}

# What a sealed day is split by: hours, so that a file spans little time, or sensors.
SEAL_BY = {"time": "bucket div 3600", "sensor": "sensor_type"}

# Up to this many ranges of batches, and this many days, are told by literal conditions.
MAX_LITERAL_RANGES, MAX_LITERAL_DAYS = 100, 2_000


class ForeignBatchError(ValueError):
    """A batch id that another writer has committed under the same ``stream_id``."""


class _Seal(NamedTuple):
    """The newest published generation."""

    gen: int
    horizon: date
    # Days before this are dropped for good.
    keep_from: date
    # Sealed (stream, first batch, last batch); None if there are too many for literals.
    covered: list[tuple[str, int, int]] | None
    # Sealed days by the generation that holds them; None if there are too many for literals.
    days: dict[int, list[date]] | None


class Store:
    def __init__(self, spark: SparkSession, root: str, stream_id: str | None = None):
        """``stream_id`` names the source of appended batches; streams must have one."""
        self.spark = prepare(spark)
        self.root = root.rstrip("/")
        self.has_stream = stream_id is not None
        self.stream_id = "main" if stream_id is None else stream_id

    # Writing

    def append(
        self,
        messages: DataFrame,
        batch_id: int,
        *,
        quarantine: DataFrame | None = None,
        layout: Literal["time", "sensor"] = "time",
        also: Iterable[Sink] = (),
        writer: str | None = None,
    ) -> bool:
        """Add a batch; False if this ``writer`` has committed it already, an error if
        another one has.

        ``messages`` is read several times: pass a persisted or stored table.
        ``also`` sinks get the same rows after the store's own tables are written
        and before the batch commits.
        """
        if self._is_committed(batch_id, writer):
            return False
        part = self._part(batch_id)
        rows = messages.select(*message_columns())
        tables = {
            "messages": _sized_files(rows, SORT_BY[layout]),
            "rollup_1s": _sized_files(rollup(rows), ["bucket", "sensor_type"]),
            "ids": _sized_files(indexed(rows), ["id_bucket", "id"]),
        }
        if quarantine is not None:
            tables["quarantine"] = quarantine
        self._write_side_by_side(tables, part)
        for sink in also:
            sink(rows, batch_id)
        self._commit(rows, quarantine, part, writer)
        return True

    def _write_side_by_side(self, tables: dict[str, DataFrame], part: str) -> None:
        """The tables of a batch as concurrent jobs; the first failure is raised."""

        def write(name: str) -> None:
            overwrite(tables[name], self.root, name, part, by_day="event_date" in tables[name].columns)

        with ThreadPoolExecutor(len(tables)) as pool:
            for job in [pool.submit(inheritable_thread_target(self.spark)(write), n) for n in tables]:
                job.result()

    def _commit(
        self, rows: DataFrame, quarantine: DataFrame | None, part: str, writer: str | None
    ) -> None:
        daily = rows.groupBy("event_date").agg(
            F.count(F.lit(1)).alias("day_rows"),
            F.min("ts_ms").alias("min_ts_ms"),
            F.max("ts_ms").alias("max_ts_ms"),
        )
        # One element per day of the batch.
        summary = daily.agg(
            F.coalesce(F.sum("day_rows"), F.lit(0)).alias("rows"),
            F.min("min_ts_ms").alias("min_ts_ms"),
            F.max("max_ts_ms").alias("max_ts_ms"),
            F.collect_list(F.struct("event_date", "day_rows")).alias("days"),
        )
        # As written: working it out again may cost a join of the whole batch.
        rejected = 0 if quarantine is None else read_table(self.spark, self.root, "quarantine", part).count()
        overwrite(
            summary.withColumns(
                {
                    "quarantined": F.lit(rejected).cast("bigint"),
                    "writer": F.lit(writer).cast("string"),
                }
            ),
            self.root,
            "commits",
            part,
        )

    def _part(self, batch_id: int) -> str:
        return f"stream_id={self.stream_id}/batch_id={batch_id}"

    def _is_committed(self, batch_id: int, writer: str | None) -> bool:
        found = read_table(self.spark, self.root, "commits", self._part(batch_id)).first()
        if found is None:
            # Its commit row may be gone once it is sealed.
            seal = self.newest_seal()
            if seal is None:
                return False
            found = (
                self.of_gen("seal_coverage", seal.gen)
                .filter(F.col("stream_id") == self.stream_id)
                .filter(F.lit(batch_id).between(F.col("from_batch"), F.col("to_batch")))
                .first()
            )
        if found is not None and found["writer"] != writer:
            raise ForeignBatchError(
                f"batch {batch_id} of stream {self.stream_id!r} was committed by "
                f"{found['writer']!r}, not by {writer!r}; give each source a stream_id of its own"
            )
        return found is not None

    # Reading

    def commits(self) -> DataFrame:
        return read_table(self.spark, self.root, "commits")

    def snapshot(self) -> "Snapshot":
        """The batches and seals committed by now, for several consistent reads."""
        return Snapshot(self)

    def messages(self, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
        return self.snapshot().messages(from_ms, to_ms)

    def rollup(self) -> DataFrame:
        return self.snapshot().rollup()

    def ids(self) -> Ids:
        """The ids of all stored messages, to be probed."""
        return self.snapshot().ids()

    def quarantine(self) -> DataFrame:
        return self.snapshot().quarantine()

    def count(self) -> DataFrame:
        """Number of stored messages, from commit and seal rows alone."""
        seal = self.newest_seal()
        rows = self.unsealed(self._committed_days(), seal).select("day_rows")
        if seal is not None:
            rows = rows.unionByName(self.of_gen("seal_days", seal.gen).select("day_rows"))
        return rows.agg(F.coalesce(F.sum("day_rows"), F.lit(0)).alias("messages"))

    def arrived(self) -> int:
        """Rows that committed batches of this stream were given, quarantined ones included,
        from commit rows and sealed ranges alone."""
        seal = self.newest_seal()
        rows = self._open_commits(seal).select("stream_id", _arrived())
        if seal is not None:
            rows = rows.unionByName(self.of_gen("seal_coverage", seal.gen).select("stream_id", "arrived"))
        return rows.filter(F.col("stream_id") == self.stream_id).agg(F.coalesce(F.sum("arrived"), F.lit(0))).first()[0]

    def _open_commits(self, seal: _Seal | None) -> DataFrame:
        """Commit rows that no sealed range covers."""
        if seal is None:
            return self.commits()
        listed = _covered(self.commits(), self._coverage(seal.gen)).select("stream_id", "batch_id")
        return self.commits().join(listed, ["stream_id", "batch_id"], "left_anti")

    def _coverage(self, gen: int) -> DataFrame:
        return self.of_gen("seal_coverage", gen).select("stream_id", "from_batch", "to_batch")

    def latest_ms(self) -> int | None:
        """Event time of the newest committed message."""
        seal = self.newest_seal()
        newest = self.commits().select("max_ts_ms")
        if seal is not None:
            newest = newest.unionByName(self.of_gen("seal_days", seal.gen).select("max_ts_ms"))
        return newest.agg(F.max("max_ts_ms")).first()[0]

    def _committed_days(self) -> DataFrame:
        """One row per committed batch and day: ``event_date, day_rows``."""
        return self.commits().select("stream_id", "batch_id", F.inline("days"))

    def synthesis(self, from_ms: int, to_ms: int) -> DataFrame:
        return self.snapshot().synthesis(from_ms, to_ms)

    def synthesis_requests(self, requests: DataFrame) -> DataFrame:
        return self.snapshot().synthesis_requests(requests)

    def trailing_hour(self, as_of_ms: int | None = None) -> DataFrame:
        """Synthesis of the hour up to ``as_of_ms``, by default the newest message."""
        end = self.latest_ms() if as_of_ms is None else as_of_ms
        end = 0 if end is None else end
        return self.synthesis(end - MS_PER_HOUR, end)

    # Sealing

    def seal(
        self,
        before: date,
        layout: Literal["time", "sensor"] = "time",
        keep_from: date = date.min,
    ) -> int:
        """Rewrite the days before ``before`` that have unsealed rows; returns the
        generation readers see from then on.

        Days before ``keep_from`` (retention; it must not lie after ``before``) are
        left out and thereby dropped, for good: rows that come for them later stay
        invisible. Nothing is rewritten for that.
        """
        if keep_from > before:
            raise ValueError("only days before the sealed horizon can be dropped")
        last = self.newest_seal()
        gen = 1 if last is None else last.gen + 1
        horizon = before if last is None else max(before, last.horizon)
        part = f"gen={gen}"
        if last is not None:
            keep_from = max(keep_from, last.keep_from)
        kept_day = F.col("event_date") >= _day(keep_from)
        # Written first and read back: batches that commit from here on stay live.
        taken = self._open_commits(last).select(
            "stream_id", F.col("batch_id").alias("from_batch"), F.col("batch_id").alias("to_batch"), "writer", _arrived()
        )
        if last is not None:
            taken = taken.unionByName(self.of_gen("seal_coverage", last.gen).drop("gen"))
        overwrite(_merged_ranges(taken).coalesce(1), self.root, "seal_coverage", part)
        coverage = self._coverage(gen)
        due = (
            _covered(self._committed_days(), coverage)
            .filter((F.col("event_date") < F.lit(horizon)) & kept_day)
            .select("stream_id", "batch_id", "event_date")
        )
        due = self.unsealed(due, last)
        dirty = due.select("event_date").distinct()

        messages = self._to_seal("messages", message_columns(), due, dirty, last)
        overwrite(
            _sized_files(messages, SORT_BY[layout], SEAL_BY[layout]),
            self.root,
            "sealed_messages",
            part,
            by_day=True,
        )
        columns = ["event_date", "bucket", "sensor_type", *PARTIAL_VALUES]
        parts = self._to_seal("rollup_1s", columns, due, dirty, last)
        merged = merge_partials(parts, *columns[:3])
        overwrite(
            _sized_files(merged, ["bucket", "sensor_type"], SEAL_BY["time"]),
            self.root,
            "sealed_rollup_1s",
            part,
            by_day=True,
        )
        for finer, size in zip(BLOCK_SECONDS, BLOCK_SECONDS[1:]):
            # Built upwards: each level reads the one below it, which is written already.
            below = self.of_gen(f"sealed_rollup_{finer}s", gen)
            start = F.col("bucket") - F.pmod(F.col("bucket"), F.lit(size))
            blocks = merge_partials(below.withColumn("bucket", start), *columns[:3])
            overwrite(
                _sized_files(blocks, ["bucket", "sensor_type"], SEAL_BY["time"]),
                self.root,
                f"sealed_rollup_{size}s",
                part,
                by_day=True,
            )
        ids = self._to_seal("ids", ID_COLUMNS, due, dirty, last)
        overwrite(_sized_files(ids, ["id_bucket", "id"], "id_bucket"), self.root, "sealed_ids", part, by_day=True)
        days = self.of_gen("sealed_messages", gen).groupBy("event_date").agg(
            F.lit(gen).cast("bigint").alias("data_gen"),
            F.count(F.lit(1)).alias("day_rows"),
            F.max("ts_ms").alias("max_ts_ms"),
        )
        if last is not None:
            kept = self.of_gen("seal_days", last.gen).drop("gen").filter(kept_day)
            days = days.unionByName(kept.join(dirty, "event_date", "left_anti"))
        overwrite(days.coalesce(1), self.root, "seal_days", part)
        published = self.spark.range(1).select(
            _day(horizon).alias("horizon"), _day(keep_from).alias("keep_from")
        )
        overwrite(published.coalesce(1), self.root, "seals", part)
        return gen

    def _to_seal(self, name, columns, due, dirty, last) -> DataFrame:
        """All rows of the dirty days: the batches due and the previous seal."""
        rows = read_table(self.spark, self.root, name)
        keys = ["stream_id", "batch_id", "event_date"]
        fresh = semi_join(rows, due, keys, small=keys_fit_broadcast(due)).select(*columns)
        if last is None:
            return fresh
        old = self.sealed(name, last).join(dirty, "event_date", "left_semi")
        return old.select(*columns).unionByName(fresh)

    def superseded(self, seal: _Seal | None = None) -> DataFrame:
        """Batches whose rows are all sealed, by the newest seal if none is given; their
        folders may be deleted after a grace period for running readers."""
        seal = seal or self.newest_seal()
        if seal is None:
            return self.commits().select("stream_id", "batch_id").limit(0)
        coverage = self._coverage(seal.gen)
        return (
            _covered(self.commits(), coverage)
            .filter(F.coalesce(F.array_max("days.event_date") < F.lit(seal.horizon), F.lit(True)))
            .select("stream_id", "batch_id")
        )

    def remove_superseded(self, grace: timedelta = timedelta(hours=1)) -> int:
        """Delete what no reader needs any more; returns the number of folders deleted.

        Batches that ``superseded`` lists lose their messages, rollup and commit row (the
        sealed ranges remember their ids, their quarantine stays), older generations the
        days that a newer one has written anew, and their own rows. Nothing younger than
        ``grace`` goes, and no generation while the newest is younger: readers that
        began before may still be at it. A run that is cut short is simply repeated.
        """
        seal = self.newest_seal()
        if seal is None:
            return 0
        before = datetime.now(timezone.utc) - grace
        files = Folders(self.spark, self.root, before)
        removed = 0
        for row in self.superseded().toLocalIterator():
            part = f"stream_id={row['stream_id']}/batch_id={row['batch_id']}"
            if files.is_old(f"commits/{part}"):
                removed += sum(files.delete(f"{name}/{part}") for name in ("messages", "rollup_1s", "ids", "commits"))
        if not files.is_old(f"seals/gen={seal.gen}"):
            return removed
        # A row a sealed day.
        current = {(r["data_gen"], r["event_date"]) for r in self.of_gen("seal_days", seal.gen).collect()}
        gens = {gen for gen, _ in current}
        for name in ("sealed_messages", "sealed_ids", *(f"sealed_rollup_{size}s" for size in BLOCK_SECONDS)):
            for folder in files.children(name):
                gen = int(folder.removeprefix("gen="))
                if gen > seal.gen:
                    continue
                if gen not in gens:
                    removed += files.delete(f"{name}/{folder}")
                    continue
                for day in files.children(f"{name}/{folder}"):
                    if (gen, date.fromisoformat(day.removeprefix("event_date="))) not in current:
                        removed += files.delete(f"{name}/{folder}/{day}")
        for name in ("seals", "seal_days", "seal_coverage"):
            for folder in files.children(name):
                if int(folder.removeprefix("gen=")) < seal.gen:
                    removed += files.delete(f"{name}/{folder}")
        return removed

    def sealed(self, name: str, seal: _Seal) -> DataFrame:
        """The rows of table ``name`` that ``seal`` holds."""
        rows = read_table(self.spark, self.root, f"sealed_{name}")
        if seal.days is not None:
            # On partition columns only: no join, and folders of older generations are not read.
            held = F.lit(False)
            for gen, days in seal.days.items():
                held = held | ((F.col("gen") == gen) & F.col("event_date").isin([_day(d) for d in days]))
            return rows.filter(held)
        current = self.of_gen("seal_days", seal.gen).select(
            "event_date", F.col("data_gen").alias("gen")
        )
        # One key of 16 bytes per day: below 60 MB for the years 0001 to 9999.
        return semi_join(rows, current, ["event_date", "gen"], small=True)

    def unsealed(self, rows: DataFrame, seal: _Seal | None) -> DataFrame:
        """Rows, with ``stream_id, batch_id, event_date``, that ``seal`` does not hold."""
        if seal is None:
            return rows
        rows = rows.filter(F.col("event_date") >= _day(seal.keep_from))
        recent = F.col("event_date") >= F.lit(seal.horizon)
        if seal.covered is not None:
            # On partition columns only, so superseded folders are never scanned.
            live = F.lit(True)
            for stream_id, first, last in seal.covered:
                live = live & ~_in_range(F.lit(stream_id), F.lit(first), F.lit(last))
            return rows.filter(recent | live)
        coverage = self.of_gen("seal_coverage", seal.gen).select(
            F.col("stream_id").alias("_stream"), "from_batch", "to_batch"
        )
        # Ranges are disjoint: a row meets one at most.
        inside = _in_range(F.col("_stream"), F.col("from_batch"), F.col("to_batch"))
        joined = rows.join(coverage, inside, "left").filter(recent | F.col("_stream").isNull())
        return joined.drop("_stream", "from_batch", "to_batch")

    def newest_seal(self) -> _Seal | None:
        newest = read_table(self.spark, self.root, "seals").orderBy(F.desc("gen")).first()
        if newest is None:
            return None
        coverage = self.of_gen("seal_coverage", newest["gen"]).limit(MAX_LITERAL_RANGES + 1)
        ranges = [(r["stream_id"], r["from_batch"], r["to_batch"]) for r in coverage.collect()]
        few = len(ranges) <= MAX_LITERAL_RANGES
        sealed = self.of_gen("seal_days", newest["gen"]).select("event_date", "data_gen").limit(MAX_LITERAL_DAYS + 1).collect()
        days: dict[int, list[date]] = {}
        for row in sealed:
            days.setdefault(row["data_gen"], []).append(row["event_date"])
        few_days = len(sealed) <= MAX_LITERAL_DAYS
        return _Seal(newest["gen"], newest["horizon"], newest["keep_from"], ranges if few else None, days if few_days else None)

    def of_gen(self, name: str, gen: int) -> DataFrame:
        return read_table(self.spark, self.root, name, f"gen={gen}")


class Snapshot:
    """One committed state of a store.

    The commit rows are listed once and the size of that list is checked once, so
    messages and rollup come from the same batches. Batches whose rows are all sealed are
    none of them. The list is broadcast; a store with more live batches than that bears
    joins it in a shuffle, and is due for sealing.
    """

    def __init__(self, store: Store):
        self._store = store
        self._seal = store.newest_seal()
        self._batches = store.commits().select("stream_id", "batch_id")
        self._live_batches = self._batches
        if self._seal is not None:
            gone = store.superseded(self._seal)
            self._live_batches = self._batches.join(gone, ["stream_id", "batch_id"], "left_anti")
        size = measure(self._live_batches)
        self._few_batches, self._any_live = size.fits_broadcast, size.rows > 0

    def messages(self, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
        """All messages, or those in ``[from_ms, to_ms]``."""
        rows = self._rows("messages", message_columns())
        return rows if from_ms is None else rows.filter(closed_range(from_ms, to_ms))

    def rollup_partials(self) -> DataFrame:
        """Partials by second and sensor; late rows give a second several."""
        return self._rows("rollup_1s", ["bucket", "sensor_type", *PARTIAL_VALUES, "event_date"])

    def rollup(self) -> DataFrame:
        """One partial per second and sensor."""
        return merge_partials(self.rollup_partials(), "event_date", "bucket", "sensor_type")

    def ids(self) -> Ids:
        return Ids(self._rows("ids", ID_COLUMNS))

    def synthesis(self, from_ms: int, to_ms: int) -> DataFrame:
        """Unsealed seconds from their rollup, sealed ones as the fewest blocks of a second,
        a minute, an hour or a day; raw rows only of the first and the last second."""
        if self._seal is None:
            return synthesis_of(hybrid_partials(self.messages(), self.rollup_partials(), from_ms, to_ms))
        if self._any_live:
            live = self._live("rollup_1s", ["bucket", "sensor_type", *PARTIAL_VALUES, "event_date"])
            parts = hybrid_partials(self.messages(), live, from_ms, to_ms)
        else:
            parts = edge_partials(self.messages(), from_ms, to_ms)
        for size, ranges in fewest_blocks(from_ms, to_ms).items():
            parts = parts.unionByName(in_ranges(self._store.sealed(f"rollup_{size}s", self._seal), ranges))
        return synthesis_of(parts)

    def synthesis_requests(self, requests: DataFrame) -> DataFrame:
        return synthesis_requests(self.messages(), self.rollup_partials(), requests)

    def quarantine(self) -> DataFrame:
        rows = read_table(self._store.spark, self._store.root, "quarantine")
        if self._seal is None:
            return self._committed(rows)
        # Commit rows of sealed batches may be gone; their ranges stand for them.
        coverage = self._store._coverage(self._seal.gen)
        listed = _covered(self._batches, coverage).select("stream_id", "batch_id")
        live = self._batches.join(listed, ["stream_id", "batch_id"], "left_anti")
        sealed = _covered(rows, coverage).select(rows.columns)
        fresh = semi_join(rows, live, ["stream_id", "batch_id"], small=keys_fit_broadcast(live))
        return fresh.select(rows.columns).unionByName(sealed)

    def _committed(self, rows: DataFrame) -> DataFrame:
        return semi_join(rows, self._live_batches, ["stream_id", "batch_id"], small=self._few_batches)

    def _live(self, name: str, columns: list[str]) -> DataFrame:
        """The committed rows no seal holds."""
        rows = read_table(self._store.spark, self._store.root, name)
        return self._committed(self._store.unsealed(rows, self._seal)).select(*columns)

    def _rows(self, name: str, columns: list[str]) -> DataFrame:
        """Sealed rows and the committed rows no seal holds."""
        if self._seal is not None and not self._any_live:
            return self._store.sealed(name, self._seal).select(*columns)
        live = self._live(name, columns)
        if self._seal is None:
            return live
        return self._store.sealed(name, self._seal).select(*columns).unionByName(live)


def _arrived() -> Column:
    """Rows of a batch: its messages and its quarantine."""
    return (F.col("rows") + F.col("quarantined")).alias("arrived")


def _day(day: date) -> Column:
    # As text: Python prints years before 1000 without their zeros, which Java refuses.
    return F.lit(day.isoformat()).cast("date")


def _in_range(stream_id: Column, first: Column, last: Column) -> Column:
    return (F.col("stream_id") == stream_id) & F.col("batch_id").between(first, last)


def _covered(rows: DataFrame, coverage: DataFrame) -> DataFrame:
    """Rows, with ``stream_id, batch_id``, whose batch lies in a range of ``coverage``."""
    inside = F.col("batch_id").between(F.col("from_batch"), F.col("to_batch"))
    return rows.join(coverage, "stream_id").filter(inside).drop("from_batch", "to_batch")


def _merged_ranges(ranges: DataFrame) -> DataFrame:
    """Disjoint ranges of batch ids per stream and writer, adjacent ones as one."""
    in_order = Window.partitionBy("stream_id", "writer").orderBy("from_batch", "to_batch")
    reach = F.max("to_batch").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.coalesce((F.col("from_batch") > reach + 1).cast("int"), F.lit(1))
    return (
        ranges.withColumn("_starts", starts)
        .withColumn("_island", F.sum("_starts").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("stream_id", "writer", "_island")
        .agg(
            F.min("from_batch").alias("from_batch"),
            F.max("to_batch").alias("to_batch"),
            F.sum("arrived").alias("arrived"),
        )
        .select("stream_id", "from_batch", "to_batch", "writer", "arrived")
    )


def _sized_files(rows: DataFrame, order: list[str], by: str = "0") -> DataFrame:
    """Rows grouped by day (and ``by``) for writing, sorted within tasks.

    Adaptive execution merges small groups and splits big ones, so a batch gives
    few files however many tasks or days it has, and a busy day or sensor is
    written by many tasks. Unlike a range partitioning this samples nothing.
    """
    grouped = rows.withColumn("_group", F.expr(by)).hint(
        "rebalance", F.col("event_date"), F.col("_group")
    )
    return grouped.drop("_group").sortWithinPartitions("event_date", *order)
