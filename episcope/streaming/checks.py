"""Streaming twins of the batch checks.

Each function takes a streaming DataFrame and returns one; the caller picks sink, trigger and
checkpoint folder. ``run_to_end`` drives a stream over everything that is available now.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo,
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

from episcope.operators.expectations import Expectation, run_suite
from episcope.operators.statistics import COMPONENT, long_components
from episcope.session import scratch_folder, ship_package

FRAMES_PER_BLOCK = 4_096


def read_table_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Files of a Parquet folder as a stream, with the schema the folder has now."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_moments(stream: DataFrame, features: Mapping[str, str]) -> DataFrame:
    """Running count, mean and population std per component (update or complete mode)."""
    long = long_components(stream, features)
    return long.groupBy(*COMPONENT).agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")
    )


def stream_expectations(stream: DataFrame, suite: Sequence[Expectation], time: str, window: str,
                        lateness: str) -> DataFrame:
    """The compiled suite per event-time window; later rows than ``lateness`` are left out.

    In append mode a window is given once, when the watermark has passed its end, and its state goes.
    Only rules that look at one row can run on a stream.
    """
    ordered = [e.type for e in suite if e.prepare or e.unique]
    if ordered:
        raise ValueError(f"rules that need other rows cannot run on a stream: {ordered}")
    windowed = stream.withWatermark(time, lateness).withColumn("window", F.window(time, window))
    results = run_suite(windowed, suite, by=["window"])
    return results.select(F.col("window.start").alias("window_start"), *[c for c in results.columns if c != "window"])


def suite_per_batch(suite: Sequence[Expectation], path: str, by: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: the suite's results on every micro-batch, in a folder per batch.

    The folder carries the number of the batch and is written over, so a batch that Spark runs again leaves
    one result. All rules can be used, also those that look at other rows of the batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        run_suite(batch, suite, by, observed=True).write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    return write


_STATUS = "generation long, sequence long, rows long, late long, highest long, words array<long>"
_SEEN = "rows array<long>, late array<long>, generation array<long>, sequence array<long>, touched array<long>, words array<long>"


def _block_processor(names: list[str], time: str, expiry_ms: int, block: int, together: int) -> StatefulProcessor:
    """The keyed state of ``stream_chain``.

    The class is made here, so that it is shipped by value: Spark also starts it in a worker beside the driver,
    which has no copy of this package.
    """
    *outer, last, block_name = names

    class Blocks(StatefulProcessor):
        """Frame numbers seen in one block of ``together`` episodes: counts, and bitmaps as 64-bit words.

        One value, so that they cost two calls to the state server a batch, whatever arrives. An episode of
        which nothing is held has sequence 0.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.seen = handle.getValueState("seen", _SEEN)

        def read(self) -> list[np.ndarray] | None:
            held = self.seen.get()
            return None if held is None else [np.array(values, np.int64) for values in held]

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
            now, behind = timerValues.getCurrentProcessingTimeInMs(), timerValues.getCurrentWatermarkInMs()
            held = self.read()
            number, late, generation, sequence, touched, words = held or [
                *np.zeros((5, together), np.int64), np.zeros(together * block // 64, np.int64)
            ]
            words = words.reshape(together, block // 64)
            seen = np.zeros((together, block), dtype=bool)
            came = np.zeros(together, np.int64)
            for chunk in rows:
                ms = chunk[time].astype("datetime64[ms]").astype("int64").to_numpy()
                member = chunk["member"].to_numpy()
                seen[member, chunk["place_in_block"].to_numpy()] = True
                came += np.bincount(member, minlength=together)
                late += np.bincount(member[ms < behind], minlength=together)
            here = came > 0
            generation[here & (sequence == 0)] = now
            number += came
            sequence[here] += 1
            touched[here] = now
            words = words | np.packbits(seen, axis=1, bitorder="little").view("<i8")
            self.seen.update(tuple(values.tolist() for values in (number, late, generation, sequence, touched, words.ravel())))
            if held is None:  # one timer a state; it is moved on when it fires too early
                self.handle.registerTimer(now + expiry_ms)
            bits = np.unpackbits(words[here].view(np.uint8), axis=1, bitorder="little")
            highest = block - 1 - bits[:, ::-1].argmax(axis=1)
            n = int(here.sum())
            lasts = [key[-2]] * n if together == 1 else (int(key[-2]) + np.flatnonzero(here)).tolist()
            yield pd.DataFrame(
                {
                    **{c: [k] * n for c, k in zip(outer, key, strict=False)},
                    last: lasts, block_name: [key[-1]] * n,
                    "generation": generation[here], "sequence": sequence[here], "rows": number[here], "late": late[here],
                    "highest": int(key[-1]) * block + highest, "words": list(words[here]),
                }
            )

        def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
            held = self.read()
            if held is not None:
                sequence, touched, words = held[3], held[4], held[5].reshape(together, block // 64)
                gone = touched + expiry_ms <= expiredTimerInfo.getExpiryTimeInMs()
                for values in (*held[:5], words):
                    values[gone] = 0
                if sequence.any():
                    self.seen.update(tuple(values.tolist() for values in held))
                    self.handle.registerTimer(int(touched[sequence > 0].min()) + expiry_ms)
                else:
                    self.seen.clear()
            return iter(())

        def close(self) -> None:
            pass

    return Blocks()


def stream_chain(stream: DataFrame, keys: Sequence[str], frame: str, time: str, lateness: str,
                 expiry_ms: int, block: int = FRAMES_PER_BLOCK, together: int = 1) -> DataFrame:
    """Gaps and duplicates of frame numbers as they arrive; no row is left out, late ones are counted.

    State is kept per episode and block of frame numbers, in RocksDB: counts and a bitmap of what was seen, so
    an episode of any length is spread over many small states. Each touched block emits its status so far, with
    its bitmap; ``chain_status`` turns the statuses into gaps and duplicates. A row is late if its time lies
    behind the watermark. A block that gets no row for ``expiry_ms`` of processing time is forgotten by its
    timer; if rows come later they begin a new generation, which ``chain_status`` joins with the old one.

    Every state costs calls whatever it holds. For many short episodes, ``together`` neighbours of the last key,
    a whole number, can share one; what is emitted and forgotten stays per episode and block.
    """
    if block % 64:
        raise ValueError("a block is a whole number of 64-bit words")
    ship_package(stream.sparkSession)
    *outer, last = keys
    member = F.lit(0).cast("long") if together == 1 else F.pmod(F.col(last), F.lit(together)).cast("long")
    prepared = stream.withWatermark(time, lateness).select(
        *outer, last if together == 1 else (F.col(last) - member).alias(last), F.floor(F.col(frame) / block).alias("block"),
        member.alias("member"), (F.col(frame) % block).cast("long").alias("place_in_block"), time,
    )
    types = dict(prepared.dtypes)
    names = [*keys, "block"]
    schema = ", ".join(f"{n} {types[n]}" for n in names) + ", " + _STATUS
    # Timers of processing time: with event-time expiry, rows behind the watermark would never get here.
    return prepared.groupBy(*names).transformWithStateInPandas(
        _block_processor(names, time, expiry_ms, block, together), schema, "append", "processingTime"
    )


def chain_status(statuses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latest status per block and generation, put together to gaps, duplicates and late rows per episode.

    A gap is a frame number below the highest seen one that never came.
    """
    latest = statuses.groupBy(*keys, "block", "generation").agg(
        F.max_by(F.struct("rows", "late", "highest", "words"), "sequence").alias("s")
    )
    # Generations of a block can have seen the same frames: their bitmaps are joined word by word.
    words = latest.select(*keys, "block", F.posexplode("s.words").alias("_w", "_bits")).where("_bits <> 0")
    seen = words.groupBy(*keys, "block", "_w").agg(F.bit_or("_bits").alias("_bits"))
    distinct = seen.groupBy(*keys).agg(F.sum(F.bit_count("_bits")).alias("_distinct"))
    totals = latest.groupBy(*keys).agg(
        F.sum("s.rows").alias("rows"), F.max("s.highest").alias("_highest"), F.sum("s.late").alias("late")
    )
    return totals.join(distinct, list(keys)).select(
        *keys, "rows", (F.col("_highest") + 1 - F.col("_distinct")).alias("gaps"),
        (F.col("rows") - F.col("_distinct")).alias("duplicates"), "late",
    )


#: Settings of a run: state in RocksDB, and whether a batch may follow that has no new input.
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def _settings(spark: SparkSession, wanted: Mapping[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _started(stream: DataFrame, mode: str, folder: str):
    return stream.writeStream.outputMode(mode).trigger(availableNow=True).option(
        "checkpointLocation", f"{folder}/checkpoint"
    )


def _fresh_folder(spark: SparkSession) -> tuple[str, str]:
    name = f"stream_{uuid.uuid4().hex}"
    return name, f"{scratch_folder(spark)}/{spark.sparkContext.applicationId}/{name}"


def run_to_end(stream: DataFrame, mode: str, *, into_memory: bool, idle_batches: bool = True) -> DataFrame:
    """Run over all available input and return the result table.

    ``into_memory`` is for aggregates of bounded size; everything else goes to Parquet files.
    ``idle_batches=False`` ends with the last input; a stream whose state expires by the clock would
    otherwise ask for another batch for ever.
    """
    spark = stream.sparkSession
    name, folder = _fresh_folder(spark)
    writer = _started(stream, mode, folder)
    with _settings(spark, {_STORE: _ROCKS, _IDLE: str(idle_batches).lower()}):
        if into_memory:
            started = writer.format("memory").queryName(name).start()
        else:
            started = writer.format("parquet").option("path", f"{folder}/out").start()
        started.awaitTermination()
    return spark.table(name) if into_memory else spark.read.parquet(f"{folder}/out")


def run_in_slices(slices: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame], mode: str,
                  each: Callable[[str], Callable[[DataFrame, int], None]] | None = None,
                  idle_batches: bool = True) -> DataFrame:
    """Feed slices one after another to a stream, each by as many files as its plan has tasks, as one batch.

    ``build`` makes the result from the stream of all slices' files; every slice is one run over what is new,
    on one checkpoint, so state and watermark go on. ``each`` makes a ``foreachBatch`` function from the folder
    that results go to; without it they are appended as Parquet files. Returns the results.
    """
    spark = slices[0].sparkSession
    _, folder = _fresh_folder(spark)
    with _settings(spark, {_STORE: _ROCKS, _IDLE: str(idle_batches).lower()}):
        for number, part in enumerate(slices):
            part.write.parquet(f"{folder}/in/slice={number}")
            stream = read_table_stream(spark, f"{folder}/in", files_per_trigger=2**31 - 1).drop("slice")
            writer = _started(build(stream), mode, folder)
            if each is None:
                started = writer.format("parquet").option("path", f"{folder}/out").start()
            else:
                started = writer.foreachBatch(each(f"{folder}/out")).start()
            started.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def rounded_moments(df: DataFrame) -> DataFrame:
    def six(c: str) -> Column:
        return (F.round(c, 6) + F.lit(0.0)).alias(c)

    return df.select(*COMPONENT, "count", six("mean"), six("std"))
