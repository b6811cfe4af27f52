"""Structured Streaming: windowed counts, keyed latest-wins snapshots, state folds, with late data bounded by watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.history import latest


def windowed_counts(events: DataFrame, time: str, kind: str, width: str, late: str | None) -> DataFrame:
    """window start, kind, n; rows later than the watermark are left out. late: None where the events carry a watermark."""
    e = (events.withWatermark(time, late) if late else events).groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.col("w.start").alias("start"), kind, "n")


def once(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The events without repeats of the same keys; state is dropped behind the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def state_fold(events: DataFrame, legal: set[tuple[str, str]]) -> DataFrame:
    """job_id, state, events, illegal, late after each micro-batch: the last state of each key and how often a step was not legal.

    events: job_id, sequence, to_status. legal: pairs of states (a parameter). An event whose sequence is not above the
    last one of its key came a batch late: it is counted, and neither sets the state back nor is judged as a step. State
    is one small row a key.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, last, n, bad, late = state.get if state.exists else (None, None, 0, 0, 0)
        rows = pd.concat(list(batches)).sort_values("sequence")
        for at, s in zip(rows["sequence"].tolist(), rows["to_status"]):
            if s is None or at != at:
                continue
            n += 1
            if last is not None and at <= last:
                late += 1
                continue
            bad += int(now is not None and (now, s) not in legal)
            now, last = s, int(at)
        state.update((now, last, n, bad, late))
        yield pd.DataFrame([(key[0], now, n, bad, late)], columns=["job_id", "state", "events", "illegal", "late"])

    out, kept = "job_id string, state string, events long, illegal long, late long", "state string, last long, events long, illegal long, late long"
    return events.where("job_id is not null").groupBy("job_id").applyInPandasWithState(fold, out, kept, "update", GroupStateTimeout.NoTimeout)


BUCKETS = 16  # parts of the keys that are rewritten apart


def snapshot_sink(events: DataFrame, key: str, order: str, fields: list[str], path: str, checkpoint: str, trigger: str = "5 seconds", buckets: int = BUCKETS, every: int = 10):
    """Starts a query that keeps the latest row of each key below path: a delta for each micro-batch, put together every so many.

    A micro-batch writes only the latest rows of its own keys, into path/delta/<number>; after every so many the deltas
    and the base before them become path/base/<number>, partitioned by bucket of the key. A batch that is run again
    after a failure writes the same folders again, so the result is exactly once. read_snapshot gives the rows.
    """
    columns = [order, *[f for f in fields if f != order]]

    def merge(batch: DataFrame, number: int) -> None:
        new = latest(batch, key, [F.col(order)], columns)
        new.write.mode("overwrite").parquet(f"{path}/delta/{number}")
        if (number + 1) % every == 0:
            spark = batch.sparkSession
            parts = [spark.read.parquet(f"{path}/delta/{k}") for k in range(number + 1 - every, number + 1)]
            if number + 1 > every:
                parts.append(spark.read.parquet(f"{path}/base/{number - every}").drop("_bucket"))
            both = parts[0]
            for p in parts[1:]:
                both = both.unionByName(p)
            merged = latest(both, key, [F.col(order)], columns).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
            merged.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/base/{number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the folders that are written whole."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def read_snapshot(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """The latest row of each key of a snapshot: its newest base and the deltas after it."""
    bases = _numbers(spark, f"{path}/base")
    last = bases[-1] if bases else -1
    parts = [spark.read.parquet(f"{path}/delta/{k}") for k in _numbers(spark, f"{path}/delta") if k > last]
    if bases:
        parts.append(spark.read.parquet(f"{path}/base/{last}").drop("_bucket"))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return latest(both, key, [F.col(order)], [c for c in both.columns if c != key])


def drop_merged(spark: SparkSession, path: str) -> int:
    """Deletes the bases and deltas that the newest base holds; gives how many folders went. Run it while no reader is on them."""
    jvm = spark._jvm
    bases = _numbers(spark, f"{path}/base")
    if not bases:
        return 0
    old = [f"{path}/base/{k}" for k in bases[:-1]] + [f"{path}/delta/{k}" for k in _numbers(spark, f"{path}/delta") if k <= bases[-1]]
    for name in old:
        p = jvm.org.apache.hadoop.fs.Path(name)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(old)
