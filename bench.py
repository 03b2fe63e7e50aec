"""Headline timings; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query runs once to warm up, then the best of ``REPEATS`` runs counts. Results
go to Spark's ``noop`` sink, so all rows are computed and none reach the driver.
"""

import json
import os
import time
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.functions.timeaxis import with_time_columns
from pulsegrid.operators import identity, requests, synthesis
from pulsegrid.plans.batch import QUERIES
from pulsegrid.schema import message_columns
from pulsegrid.session import prepare, workspace
from pulsegrid.sources import tables
from pulsegrid.storage.store import Store
from pulsegrid.streaming.ingest import load_batch

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = 3

# Start of the timed ranges: 2024-01-10T06:30:15.250Z.
START_MS = 1_704_868_215_250
RANGES_MS = {"hour": 3_600_000, "day": 86_400_000, "span": 19 * 86_400_000}

# The dense store: every order line so many times, spread over so long from START_MS on.
DENSE_COPIES, DENSE_MS = 10, 12 * 3_600_000
DENSE_RANGES_MS = {"hour": 3_600_000, "ten_hours": 36_000_000}


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("pulsegrid-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run) -> float:
    run()
    best = float("inf")
    for _ in range(REPEATS):
        started = time.perf_counter()
        run()
        best = min(best, time.perf_counter() - started)
    return round(best, 3)


def dense_store(spark: SparkSession, shipments: DataFrame) -> Store:
    """A sealed store with some hundred messages a second: a rollup row stands for several."""
    at = F.pmod(F.xxhash64("id", "seq", "copy"), F.lit(DENSE_MS)) + F.lit(START_MS)
    copies = shipments.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(DENSE_COPIES))))
    rows = with_time_columns(copies.withColumn("ts_ms", at)).select(*message_columns())
    path = workspace(spark, "bench-dense")
    rows.write.parquet(path)
    store = Store(spark, workspace(spark, "bench-dense-store"))
    store.append(spark.read.parquet(path), 0)
    store.seal(date(2024, 2, 1))
    return store


def main() -> None:
    spark = session()
    seconds: dict[str, float] = {}
    rates: dict[str, float] = {}

    def measure(name: str, run, rows: int | None = None) -> None:
        seconds[name] = timed(run)
        if rows is not None:
            rates[name] = round(rows / seconds[name], 1)

    events = tables.messages(spark, SF_DIR)
    shipments = tables.shipments(spark, SF_DIR)
    event_rows, shipment_rows = events.count(), shipments.count()

    for name in ("synthesis_range", "synthesis_hybrid", "sql_summary", "parse_messages"):
        measure(name, lambda name=name: drain(QUERIES[name].run(spark, SF_DIR)))
    for name, rows in (("rollup_1s", event_rows), ("dedup_first", shipment_rows)):
        measure(name, lambda name=name: drain(QUERIES[name].run(spark, SF_DIR)), rows)
    measure("rollup_shipments", lambda: drain(synthesis.rollup(shipments)), shipment_rows)

    # JSON text to messages and rollup: a fresh store per run.
    log = workspace(spark, "bench-log")
    tables.raw_json(events).repartition(int(CPUS)).write.text(log)
    raw = spark.read.text(log).toDF("raw")

    def ingest() -> Store:
        store = Store(spark, workspace(spark, "bench-store"))
        load_batch(store, raw, 0)
        return store

    measure("ingest", ingest, event_rows)
    store = ingest()

    measure("store_snapshot", store.snapshot)
    now = store.snapshot()
    for name, length in RANGES_MS.items():
        bounds = START_MS, START_MS + length
        measure(f"store_raw_{name}", lambda b=bounds: drain(synthesis.synthesis(now.messages(), *b)))
        measure(f"store_hybrid_{name}", lambda b=bounds: drain(now.synthesis(*b)))

    dense = dense_store(spark, shipments).snapshot()
    for name, length in DENSE_RANGES_MS.items():
        bounds = START_MS, START_MS + length
        measure(f"store_raw_dense_{name}", lambda b=bounds: drain(synthesis.synthesis(dense.messages(), *b)))
        measure(f"store_hybrid_dense_{name}", lambda b=bounds: drain(dense.synthesis(*b)))

    stored_ids = now.ids()
    events_asked = events.withColumn("id", F.when(F.col("seq") % 2 == 0, F.col("id")).otherwise(F.concat("id", F.lit("-x"))))
    measure("store_id_probe", lambda: drain(stored_ids.known(events_asked)), event_rows)

    # All of them ask about stored shipments; half exist. 200,000 at most would be
    # the published probe count, here every order line is probed.
    unknown = F.when(F.col("seq") % 2 == 0, F.col("id")).otherwise(F.concat("id", F.lit("-x")))
    probes = shipments.withColumn("id", unknown)
    measure("id_probe", lambda: drain(identity.known_ids(probes, shipments)), shipment_rows)

    orders = tables.requests(spark, SF_DIR)
    rollup_path = workspace(spark, "bench-rollup")
    synthesis.rollup(events).write.parquet(rollup_path)
    rollup = spark.read.parquet(rollup_path)
    for count in (10, 1_000, None):
        asked = orders if count is None else orders.filter(F.col("request_id").cast("bigint") < count)
        label = "all" if count is None else str(count)
        measure(
            f"requests_{label}",
            lambda asked=asked: drain(requests.synthesis_requests(events, rollup, asked)),
            asked.count(),
        )

    print(
        json.dumps(
            {
                "metric": "total seconds over headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "per_second": rates,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
