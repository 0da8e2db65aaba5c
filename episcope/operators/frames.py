"""Contracts over frame tables and clamped sample windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episcope.functions.columns import count_true
from episcope.operators.ordered import ordered_scan

EPISODE = ("split", "episode_index")
BITS = 62  # numbers per bitmap word


# ---- frames against their episodes --------------------------------------------------------------


def frame_summary(
    frames: DataFrame, keys: Sequence[str] = EPISODE, *, index: str = "index",
    frame_index: str = "frame_index", task: str = "task_index",
) -> DataFrame:
    """Per episode: counts, ranges, exact distinct counts, and the first task.

    Distinct numbers are counted with bitmaps: rows are first reduced per run of 62 numbers to one
    long with a bit per number, which combines well before the shuffle because frames lie in order.
    Plain distinct counts would carry every row, twice, through the aggregation.
    """
    both = F.array(
        F.struct(F.lit(0).alias("kind"), F.col(index).cast("long").alias("v")),
        F.struct(F.lit(1).alias("kind"), F.col(frame_index).cast("long").alias("v")),
    )
    rows = frames.select(*keys, F.col(task).alias("_task"), F.explode(both).alias("_x")).select(
        *keys, "_task", F.col("_x.kind").alias("_kind"), F.col("_x.v").alias("_v")
    )
    bit = F.pmod("_v", F.lit(BITS))
    runs = rows.groupBy(*keys, "_kind", (F.col("_v") - bit).alias("_run")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count("_v").alias("_vn"),
        F.count("_task").alias("_tn"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
        F.sum(F.col("_v").cast("double")).alias("_sum"),
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(_v, {BITS}) as int))")).alias("_bits"),
        F.min("_task").alias("_tlo"),
        F.max("_task").alias("_thi"),
        F.sum(F.col("_task").cast("double")).alias("_tsum"),
        F.min_by("_task", "_v").alias("_first"),
    )
    is_index, is_frame = F.col("_kind") == 0, F.col("_kind") == 1

    def of(kind: Column, c: str) -> Column:
        return F.when(kind, F.col(c))

    count = F.sum(of(is_frame, "_n"))
    return runs.withColumn("_distinct", F.bit_count("_bits").cast("long")).groupBy(*keys).agg(
        count.alias("frames"),
        F.min(of(is_index, "_lo")).alias("index_min"),
        F.max(of(is_index, "_hi")).alias("index_max"),
        (F.sum(of(is_index, "_sum")) / F.sum(of(is_index, "_vn"))).alias("index_mean"),
        F.coalesce(F.sum(of(is_index, "_distinct")), F.lit(0)).alias("index_distinct"),
        F.min(of(is_frame, "_lo")).alias("frame_min"),
        F.max(of(is_frame, "_hi")).alias("frame_max"),
        F.coalesce(F.sum(of(is_frame, "_distinct")), F.lit(0)).alias("frame_distinct"),
        F.min(of(is_frame, "_tlo")).alias("task_min"),
        F.max(of(is_frame, "_thi")).alias("task_max"),
        (F.sum(of(is_frame, "_tsum")) / F.sum(of(is_frame, "_tn"))).alias("task_mean"),
        (count - F.sum(of(is_frame, "_tn"))).alias("task_nulls"),
        F.min_by(of(is_frame, "_first"), of(is_frame, "_lo")).alias("first_task"),
    )


def run_of(count: Column, low: Column, high: Column, distinct: Column, start: Column, n: Column) -> Column:
    """True if the counted values are exactly ``start .. start + n - 1``."""
    return (count == n) & (distinct == n) & (low == start) & (high == start + n - 1)


def frame_contracts(
    frames: DataFrame, episodes: DataFrame, tasks: DataFrame, keys: Sequence[str] = EPISODE
) -> DataFrame:
    """Per declared episode: length, index interval, frame order and task agreement."""
    seen = frame_summary(frames, keys)
    joined = episodes.select(*keys, "length", "dataset_from_index", "task").join(seen, list(keys), "left")
    names = tasks.select(F.col("task_index").alias("first_task"), F.col("task").alias("resolved_task"))
    joined = joined.join(names, "first_task", "left")
    n = F.col("length")

    def sure(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    return joined.select(
        *keys,
        "length",
        F.coalesce("frames", F.lit(0)).alias("frames"),
        sure(F.col("frames") == n).alias("length_ok"),
        sure(
            run_of(F.col("frames"), F.col("index_min"), F.col("index_max"), F.col("index_distinct"),
                   F.col("dataset_from_index"), n)
        ).alias("interval_ok"),
        sure(
            run_of(F.col("frames"), F.col("frame_min"), F.col("frame_max"), F.col("frame_distinct"),
                   F.lit(0), n)
        ).alias("order_ok"),
        sure(
            (F.col("task_min") == F.col("task_max")) & (F.col("task_nulls") == 0) & (F.col("resolved_task") == F.col("task"))
        ).alias("task_ok"),
    )


def contract_totals(contracts: DataFrame, keys: Sequence[str] = ("split",)) -> DataFrame:
    flags = ("length_ok", "interval_ok", "order_ok", "task_ok")
    clean = F.col(flags[0])
    for f in flags[1:]:
        clean = clean & F.col(f)
    return contracts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("episodes"),
        F.sum("frames").alias("frames"),
        *[count_true(F.col(f)).alias(f) for f in flags],
        count_true(clean).alias("consistent_episodes"),
    )


def frames_with_bounds(frames: DataFrame, episodes: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Attach the declared interval to every frame; frames of unknown episodes keep null bounds."""
    bounds = episodes.select(*keys, "dataset_from_index", "dataset_to_index")
    return frames.join(bounds, list(keys), "left")


def unknown_and_missing(frames: DataFrame, episodes: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Episodes seen only in frames (``unknown``) and declared episodes without frames (``missing``).

    Both sides meet in one aggregate. If the last key is a whole number, a row of it stands for 64 numbers, with a
    bit for each, so what a task holds is small where numbers lie close. A key with a null equals no other.
    """
    *outer, number = keys
    both = frames.select(*keys, F.lit(False).alias("_declared")).unionByName(
        episodes.select(*keys, F.lit(True).alias("_declared"))
    )
    kind = both.schema[number].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        v = F.col(number).cast("long")
        run, place = F.shiftright(v, 6), F.coalesce(v.bitwiseAND(F.lit(63)), F.lit(0)).cast("int")
        back = F.shiftleft("_run", 6).bitwiseOR(F.col("_place").cast("long")).cast(kind)
    else:
        run, place, back = F.col(number), F.lit(0), F.col("_run")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    met = both.groupBy(*outer, run.alias("_run")).agg(
        F.coalesce(F.bit_or(F.when(~F.col("_declared"), bit)), F.lit(0)).cast("long").alias("_seen"),
        F.coalesce(F.bit_or(F.when(F.col("_declared"), bit)), F.lit(0)).cast("long").alias("_known"),
    )
    null = F.lit(False)
    for c in (*outer, "_run"):
        null = null | F.col(c).isNull()

    def left(a: str, b: str) -> Column:
        return F.when(null, F.col(a)).otherwise(F.col(a).bitwiseAND(F.bitwise_not(b)))

    found = F.array(
        F.struct(F.lit("unknown").alias("finding"), left("_seen", "_known").alias("bits")),
        F.struct(F.lit("missing").alias("finding"), left("_known", "_seen").alias("bits")),
    )
    runs = met.select(*outer, "_run", F.inline(F.filter(found, lambda x: x["bits"] != 0)))
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)
    return runs.select(*outer, "_run", "finding", F.explode(places).alias("_place")).select(
        *outer, back.alias(number), "finding"
    )


def row_identity(frames: DataFrame, episodes: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Frames whose index is not the start of their episode plus the frame index."""
    joined = frames_with_bounds(frames, episodes, keys)
    return joined.where(F.col("index") != F.col("dataset_from_index") + F.col("frame_index"))


def row_identity_totals(frames: DataFrame, episodes: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Rows, violating rows and episodes, rows without identity, and episodes of a wrong length.

    Frames are counted per episode and difference of index and frame index first, so one row per
    episode meets its declaration when all is well.
    """
    keys = [*by, "episode_index"]
    gap = F.col("index").cast("long") - F.col("frame_index")
    counted = frames.groupBy(*keys, gap.alias("_gap")).agg(F.count(F.lit(1)).alias("_n"))
    declared = episodes.select(*keys, "dataset_from_index", F.col("length").alias("_length"), F.lit(True).alias("_known"))
    joined = counted.join(declared, keys, "left")
    bad = F.col("_gap") != F.col("dataset_from_index")
    per_episode = joined.groupBy(*keys, "_length", "_known").agg(
        F.sum("_n").alias("_rows"),
        F.sum(F.when(bad, F.col("_n")).otherwise(0)).alias("_bad"),
        F.sum(F.when(F.col("_gap").isNull(), F.col("_n")).otherwise(0)).alias("_nulls"),
    )
    return per_episode.groupBy(*by).agg(
        F.sum("_rows").alias("rows"),
        F.count(F.lit(1)).alias("episodes"),
        F.sum("_bad").alias("violating_rows"),
        count_true(F.col("_bad") > 0).alias("violating_episodes"),
        F.sum("_nulls").alias("null_rows"),
        count_true(F.col("_known") & (F.col("_rows") != F.col("_length"))).alias("length_errors"),
    )


def examples(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` rows per group; Spark trims each group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def summary_vs_frames(summaries: DataFrame, frames: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Published episode and task summaries against the frames they describe, per split.

    ``summaries``: keys plus ``ep_min, ep_max, ep_mean, ep_count, task_min, task_max, task_mean``.
    """
    published = summaries.withColumnsRenamed({f"task_{m}": f"pub_{m}" for m in ("min", "max", "mean")})
    both = published.join(frame_summary(frames, keys), list(keys))
    episode = F.col("episode_index")
    ep_ok = (F.col("ep_min") == episode) & (F.col("ep_max") == episode) & (F.col("ep_mean") == episode)
    task_ok = (
        (F.col("pub_min") == F.col("task_min"))
        & (F.col("pub_max") == F.col("task_max"))
        & (F.abs(F.col("pub_mean") - F.col("task_mean")) <= 1e-6)
    )
    count_ok = F.col("ep_count") == F.col("frames")
    return both.groupBy("split").agg(
        count_true(ep_ok).alias("episode_matches"),
        count_true(~ep_ok).alias("episode_differs"),
        count_true(task_ok).alias("task_matches"),
        count_true(~task_ok).alias("task_differs"),
        count_true(count_ok).alias("count_matches"),
        count_true(~count_ok).alias("count_differs"),
    )


def summary_mismatches(summaries: DataFrame, frames: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Every published summary that its frames contradict: keys, field, published, observed."""
    published = summaries.withColumnsRenamed({f"task_{m}": f"pub_{m}" for m in ("min", "max", "mean")})
    both = published.join(frame_summary(frames, keys), list(keys))
    episode = F.col("episode_index")
    pairs = {f"episode_index/{m}": (F.col(f"ep_{m}"), episode) for m in ("min", "max", "mean")}
    pairs |= {f"task_index/{m}": (F.col(f"pub_{m}"), F.col(f"task_{m}")) for m in ("min", "max", "mean")}
    pairs["episode_index/count"] = (F.col("ep_count"), F.col("frames"))
    cells = [
        F.struct(F.lit(f).alias("field"), a.cast("double").alias("published"), b.cast("double").alias("observed"))
        for f, (a, b) in pairs.items()
    ]
    long = both.select(*keys, F.explode(F.array(*cells)).alias("_c")).select(*keys, "_c.*")
    near = F.when(F.col("field") == "task_index/mean", F.abs(F.col("published") - F.col("observed")) <= 1e-6)
    return long.where(~F.coalesce(near.otherwise(F.col("published") == F.col("observed")), F.lit(False)))


def coverage_gate(totals: DataFrame, findings: DataFrame, episodes: DataFrame) -> DataFrame:
    """One row: INCOMPLETE unless everything declared was seen without errors, then CHECK_FAILED or PASS.

    ``totals`` are those of ``row_identity_totals``, ``findings`` the unknown and missing episodes.
    Wrong lengths and rows without identity are integrity errors as those are.
    """
    one = totals.agg(
        *[F.sum(c).alias(c) for c in ("rows", "episodes", "violating_rows")],
        F.sum(F.col("null_rows") + F.col("length_errors")).alias("_errors"),
    )
    found = findings.agg(F.count(F.lit(1)).alias("_found"))
    declared = episodes.agg(F.sum("length").alias("expected_rows"), F.count(F.lit(1)).alias("expected_episodes"))
    row = one.crossJoin(found).crossJoin(declared)  # one row each
    row = row.withColumn("integrity_errors", F.coalesce("_errors", F.lit(0)) + F.col("_found"))
    whole = (
        F.col("rows").eqNullSafe(F.col("expected_rows"))
        & (F.col("episodes") == F.col("expected_episodes"))
        & (F.col("integrity_errors") == 0)
    )
    status = F.when(~whole, "INCOMPLETE").when(F.col("violating_rows") > 0, "CHECK_FAILED").otherwise("PASS")
    return row.select("rows", "episodes", "violating_rows", "integrity_errors", status.alias("status"))


def select_episodes(frames: DataFrame, chosen: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Keep the chosen episodes; ``relative_index`` numbers the kept rows by absolute index."""
    kept = frames.join(chosen.select(*keys).distinct(), list(keys), "left_semi")
    return ordered_scan(kept, [], ["index"], number="relative_index").withColumn(
        "relative_index", F.col("relative_index") - 1
    )


def monotone_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Per key: how often ``value`` decreases, and how often it fails to increase, in order."""
    seen = ordered_scan(df, keys, order, lags={"_previous": value})
    return seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        count_true(F.col(value) < F.col("_previous")).alias("decreases"),
        count_true(F.col(value) <= F.col("_previous")).alias("not_increasing"),
    )


def assign_frame_fields(
    rows: DataFrame, tasks: DataFrame, keys: Sequence[str], order: Sequence[str], fps: float
) -> DataFrame:
    """On ingest: frame index, time, global index (episodes in key order) and task index."""
    numbered = ordered_scan(rows, keys, order, number="_n")
    lengths = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_len"))
    starts = ordered_scan(lengths, [], list(keys), sums={"_stop": "_len"})
    starts = starts.select(*keys, (F.col("_stop") - F.col("_len")).alias("_start"))
    named = numbered.join(starts, list(keys)).join(tasks, "task", "left")
    return named.withColumns(
        {
            "frame_index": F.col("_n") - 1,
            "timestamp": (F.col("_n") - 1) / F.lit(float(fps)),
            "index": F.col("_start") + F.col("_n") - 1,
        }
    ).drop("_n", "_start")


# ---- sample windows -----------------------------------------------------------------------------


def clamp(requested: Column, start: Column, stop: Column) -> Column:
    return F.greatest(start, F.least(stop - 1, requested))


def outside(requested: Column, start: Column, stop: Column) -> Column:
    return (requested < start) | (requested >= stop)


def window_query(
    frames: DataFrame, offsets: Sequence[int], *, base: str = "index", index: str = "index",
    start: str = "dataset_from_index", stop: str = "dataset_to_index", value: str | None = "value",
    lookup: DataFrame | None = None,
) -> DataFrame:
    """Per frame and offset: the clamped absolute index, the padding flag and the value found there.

    Values are looked up in ``lookup`` (by default in ``frames`` itself). ``base`` is the column the offset is added to; passing a relative index shows the known fault.
    """
    asked = frames.withColumn("delta_index", F.explode(F.array(*[F.lit(int(o)) for o in offsets])))
    requested = F.col(base) + F.col("delta_index")
    out = asked.withColumns(
        {
            "selected_index": clamp(requested, F.col(start), F.col(stop)),
            "is_pad": outside(requested, F.col(start), F.col(stop)),
        }
    )
    if value is None:
        return out
    # Many-to-one: the clamped index meets one frame, and each frame is met at most offsets-many times
    # from inside its episode plus the few clamped edges.
    source = frames if lookup is None else lookup
    found = source.select(F.col(index).alias("selected_index"), F.col(value).alias("selected_value"))
    return out.join(found, "selected_index", "left")


def offsets_from_seconds(seconds: Column, fps: float, tolerance: float = 1e-4) -> tuple[Column, Column]:
    """Frame offset of a time offset, and whether the time lies off the frame grid."""
    offset = F.rint(seconds * F.lit(float(fps)))
    off_grid = F.abs(offset / F.lit(float(fps)) - seconds) > F.lit(tolerance)
    return offset.cast("long"), off_grid


def action_chunks(
    frames: DataFrame, horizon: int, *, keys: Sequence[str] = EPISODE, position: str = "frame_index",
    length: str = "length", value: str = "value", block_rows: int = 65_536,
) -> DataFrame:
    """Per frame the next ``horizon`` values, clamped to the last frame, with padding flags.

    Rows are cut into position blocks; each block also gets the ``horizon - 1`` rows that follow it,
    so the look-ahead window never spans a whole episode. Positions must be 0..length-1.
    """
    blocks = F.floor(F.col(position) / block_rows)
    reach = horizon - 1
    # A row near the start of a block is also needed at the end of the block before.
    near_start = (F.col(position) % block_rows < reach) & (blocks > 0)
    homes = F.array_compact(
        F.array(
            F.struct(blocks.alias("block"), F.lit(True).alias("own")),
            F.when(near_start, F.struct((blocks - 1).alias("block"), F.lit(False).alias("own"))),
        )
    )
    spread = frames.withColumn("_home", F.explode(homes)).select("*", "_home.block", "_home.own").drop("_home")
    ahead = Window.partitionBy(*keys, "block").orderBy(position).rowsBetween(0, reach)
    last_ok = F.col(length) - 1
    steps = F.sequence(F.lit(0), F.lit(reach))
    listed = spread.withColumn("_ahead", F.collect_list(value).over(ahead)).where("own")
    taken = F.transform(
        steps, lambda k: F.get("_ahead", F.least(k, (last_ok - F.col(position)).cast("int")))
    )
    padded = F.transform(steps, lambda k: F.col(position) + k > last_ok)
    return listed.withColumns({"chunk": taken, "chunk_is_pad": padded}).drop("_ahead", "block", "own")


def common_features_union(named: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Union data sets on their shared columns with a source number; also list what was disabled."""
    if not named:
        raise ValueError("no data sets")
    order = list(next(iter(named.values())).columns)
    shared = [c for c in order if all(c in df.columns for df in named.values())]
    if not shared:
        raise ValueError("the data sets have no column in common")
    union = None
    disabled = []
    for number, (name, df) in enumerate(named.items()):
        part = df.select(*shared, F.lit(number).cast("long").alias("dataset_index"))
        union = part if union is None else union.unionByName(part)
        disabled += [(name, c) for c in df.columns if c not in shared]
    spark = union.sparkSession
    return union, spark.createDataFrame(disabled, "dataset string, disabled_column string")
