"""Contracts over episode tables: numbering, interval chains, summaries, source roll-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope.functions.columns import (
    close,
    count_true,
    scalar_cell,
    source_prefix,
    task_text,
    uniform_std,
)
from episcope.operators.ordered import ordered_scan

EPISODE_METRICS = ("min", "max", "mean", "std")
REQUIRED_COLUMNS = (
    "episode_index",
    "episode_id",
    "tasks",
    "length",
    "dataset_from_index",
    "dataset_to_index",
    "data/chunk_index",
    "data/file_index",
    "meta/episodes/chunk_index",
    "meta/episodes/file_index",
)
FILE_COLUMNS = REQUIRED_COLUMNS[6:]


def cell(feature: str, metric: str) -> Column:
    """The scalar statistic ``stats/<feature>/<metric>`` of an episode row."""
    return scalar_cell(F.col(f"`stats/{feature}/{metric}`"))


def violation_counts(df: DataFrame, counters: Mapping[str, Column]) -> DataFrame:
    """All counters in one aggregate; one row per counter with its status."""
    one = df.agg(*[count_true(c).alias(name) for name, c in counters.items()])
    return counter_rows(one)


def counter_rows(one: DataFrame) -> DataFrame:
    """Turn a one-row table of counts into rows ``(contract_name, violations, status)``."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("counter"), F.col(c).cast("long").alias("violations")) for c in one.columns]
    )
    return (
        one.select(F.explode(pairs).alias("p"))
        .select("p.counter", "p.violations")
        .withColumn("status", F.when(F.col("violations") == 0, "pass").otherwise("violations"))
    )


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows minus distinct keys, per key column."""
    return counter_rows(
        df.agg(*[(F.count(F.lit(1)) - F.count_distinct(k)).alias(f"duplicate_{k}") for k in keys])
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def guard_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pass ``df`` on, failing the job if a key repeats."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    checked = counted.where(
        F.assert_true(F.col("_rows") == 1, F.lit(f"repeated key {list(keys)}")).isNull()
    ).drop("_rows")
    return df.join(checked, list(keys), "left_semi")


# ---- numbering and chains ----------------------------------------------------------------------


def index_gaps(episodes: DataFrame) -> DataFrame:
    """Flag episodes whose index is not the previous one plus one."""
    out = ordered_scan(episodes, [], ["episode_index"], lags={"previous_index": "episode_index"})
    return out.withColumn(
        "is_gap",
        F.coalesce(F.col("episode_index") != F.col("previous_index") + 1, F.lit(False)),
    )


def chain_breaks(episodes: DataFrame) -> DataFrame:
    """Flag episodes that do not start where the previous one stops; the first must start at 0."""
    out = ordered_scan(episodes, [], ["episode_index"], lags={"previous_stop": "dataset_to_index"})
    return out.withColumn(
        "is_break", F.col("dataset_from_index") != F.coalesce("previous_stop", F.lit(0))
    )


def prefix_sum_offsets(episodes: DataFrame) -> DataFrame:
    """Add the interval that the lengths imply and whether the stored one equals it."""
    out = ordered_scan(episodes, [], ["episode_index"], sums={"expected_to_index": "length"})
    out = out.withColumn("expected_from_index", F.col("expected_to_index") - F.col("length"))
    return out.withColumn(
        "chain_ok",
        (F.col("dataset_from_index") == F.col("expected_from_index"))
        & (F.col("dataset_to_index") == F.col("expected_to_index")),
    )


def local_numbering(episodes: DataFrame, keys: Sequence[str] = ("source_prefix",)) -> DataFrame:
    """Ordinal and first frame of each episode counted inside its source prefix."""
    out = ordered_scan(
        episodes, keys, ["episode_index"], number="local_episode", sums={"local_stop": "length"}
    )
    return out.withColumns(
        {
            "local_episode": F.col("local_episode") - 1,
            "local_start": F.col("local_stop") - F.col("length"),
        }
    )


def local_vocabulary(
    episodes: DataFrame, keys: Sequence[str] = ("source_prefix",), text: str = "task_text"
) -> DataFrame:
    """Code of each text by first appearance inside a source prefix."""
    first = episodes.groupBy(*keys, text).agg(F.min("episode_index").alias("first_episode"))
    coded = ordered_scan(first, keys, ["first_episode"], number="local_code")
    return coded.withColumn("local_code", F.col("local_code") - 1)


def with_local_codes(
    episodes: DataFrame, keys: Sequence[str] = ("source_prefix",), text: str = "task_text"
) -> DataFrame:
    return episodes.join(local_vocabulary(episodes, keys, text), [*keys, text])


def numbering_offsets(episodes: DataFrame, keys: Sequence[str] = ("source_prefix",)) -> DataFrame:
    """Global minus local numbering per group, and how many rows coincide."""
    local = local_numbering(episodes, keys)
    episode = F.col("episode_index") - F.col("local_episode")
    frame = F.col("dataset_from_index") - F.col("local_start")
    return local.groupBy(*keys).agg(
        F.min(episode).alias("episode_offset_min"),
        F.max(episode).alias("episode_offset_max"),
        F.min(frame).alias("frame_offset_min"),
        F.max(frame).alias("frame_offset_max"),
        count_true((episode == 0) & (frame == 0)).alias("coincident_rows"),
    )


# ---- references and summaries -------------------------------------------------------------------


def resolve_reference(
    df: DataFrame, vocabulary: DataFrame, index: Column, out: str = "resolved_text"
) -> DataFrame:
    """Look the half-even rounded ``index`` up in the task vocabulary; unmatched stays null."""
    names = vocabulary.select(F.col("task_index").alias("_code"), F.col("task").alias(out))
    return (
        df.withColumn("_index", F.rint(index).cast("long"))
        .join(names, F.col("_index") == F.col("_code"), "left")
        .drop("_code")
        .withColumnRenamed("_index", "lookup_index")
    )


def identity_fields(episode: Column, start: Column, stop: Column) -> dict[str, Column]:
    """The seven identity summaries against the values that ``episode, start, stop`` predict."""
    return {
        "episode_index_min": close(cell("episode_index", "min"), episode),
        "episode_index_max": close(cell("episode_index", "max"), episode),
        "episode_index_mean": close(cell("episode_index", "mean"), episode),
        "episode_index_std": close(cell("episode_index", "std"), F.lit(0.0)),
        "index_min": close(cell("index", "min"), start),
        "index_max": close(cell("index", "max"), stop - 1),
        "index_mean": close(cell("index", "mean"), (start + stop - 1) / 2),
    }


def global_identity() -> dict[str, Column]:
    return identity_fields(
        F.col("episode_index"), F.col("dataset_from_index"), F.col("dataset_to_index")
    )


def local_identity() -> dict[str, Column]:
    return identity_fields(
        F.col("local_episode"), F.col("local_start"), F.col("local_start") + F.col("length")
    )


def field_violations(df: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """Violations per field."""
    return violation_counts(df, {name: ~ok for name, ok in fields.items()})


def every(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def with_source(meta: DataFrame) -> DataFrame:
    """Add source prefix and task text to stored episode rows."""
    return meta.withColumns(
        {"source_prefix": source_prefix("episode_id"), "task_text": task_text("tasks")}
    )


def identity_summary(meta: DataFrame) -> DataFrame:
    """Violations of the seven identity summaries against global numbering."""
    return field_violations(meta, global_identity())


def identity_summary_local(meta: DataFrame, keys: Sequence[str] = ("source_prefix",)) -> DataFrame:
    """The same against prefix-local numbering, per prefix, and whether coherence means coincidence."""
    local = local_numbering(with_source(meta), keys)
    good, near = every(global_identity().values()), every(local_identity().values())
    coincides = (F.col("episode_index") == F.col("local_episode")) & (
        F.col("dataset_from_index") == F.col("local_start")
    )
    return local.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("episodes"),
        count_true(near).alias("local_matches"),
        count_true(good).alias("global_matches"),
        F.bool_and(good == coincides).alias("coherent_iff_coincident"),
    )


def summary_findings(
    meta: DataFrame, vocabulary: DataFrame, keys: Sequence[str] = ("source_prefix",)
) -> DataFrame:
    """Per episode: identity and task findings, local numbering, and the four joint outcomes."""
    local = local_numbering(with_source(meta), keys)
    found = local.withColumns(
        {
            "identity_bad": ~every(global_identity().values()),
            "local_matches": every(local_identity().values()),
            "local_start_matches": close(cell("episode_index", "min"), F.col("local_episode"))
            & close(cell("index", "min"), F.col("local_start")),
            "coincides": (F.col("episode_index") == F.col("local_episode"))
            & (F.col("dataset_from_index") == F.col("local_start")),
            "published_task": cell("task_index", "min"),
        }
    ).select(
        "split", "source_prefix", "episode_index", "length", "dataset_from_index", "task_text",
        "local_episode", "local_start", "identity_bad", "local_matches", "local_start_matches",
        "coincides", "published_task",
    )
    resolved = resolve_reference(found, vocabulary, F.col("published_task"))
    resolved = resolved.withColumn(
        "task_bad", ~F.coalesce(F.col("resolved_text") == F.col("task_text"), F.lit(False))
    )
    bad, task = F.col("identity_bad"), F.col("task_bad")
    return resolved.withColumns(
        {
            "both_bad": bad & task,
            "identity_only": bad & ~task,
            "task_only": ~bad & task,
            "neither_bad": ~bad & ~task,
        }
    )


def _rollup_columns() -> list[Column]:
    names = ("identity_bad", "task_bad", "both_bad", "identity_only", "task_only", "neither_bad")
    return [
        F.count(F.lit(1)).alias("episodes"),
        F.sum("length").alias("frames"),
        *[count_true(F.col(n)).alias(n) for n in names],
        count_true(F.col("local_matches")).alias("local_matches"),
        count_true(F.col("coincides")).alias("coincident_rows"),
        (100.0 * count_true(F.col("identity_bad")) / F.count(F.lit(1))).alias("identity_bad_percent"),
        F.min(F.col("episode_index") - F.col("local_episode")).alias("episode_offset_min"),
        F.max(F.col("episode_index") - F.col("local_episode")).alias("episode_offset_max"),
        F.min(F.col("dataset_from_index") - F.col("local_start")).alias("frame_offset_min"),
        F.max(F.col("dataset_from_index") - F.col("local_start")).alias("frame_offset_max"),
    ]


def prefix_rollup(findings: DataFrame) -> DataFrame:
    """Findings per split and source prefix."""
    return findings.groupBy("split", "source_prefix").agg(*_rollup_columns())


def prefix_rollup_combined(findings: DataFrame) -> DataFrame:
    """Findings per split and prefix, per prefix, and in total; ordered worst first."""
    split, prefix = F.col("split"), F.col("source_prefix")
    sets = findings.groupingSets([[split, prefix], [prefix], []], split, prefix)
    rolled = sets.agg(F.grouping_id().alias("level"), *_rollup_columns())
    return rolled.withColumn("level", F.col("level").cast("long")).orderBy(
        "level", F.desc("identity_bad_percent"), F.desc("episodes"), "source_prefix", "split"
    )


def joint_outcomes(findings: DataFrame) -> DataFrame:
    """Truth table of identity and task findings."""
    return findings.groupBy("split", "identity_bad", "task_bad").agg(
        F.count(F.lit(1)).alias("episodes"), F.sum("length").alias("frames")
    )


# ---- named contracts ----------------------------------------------------------------------------


def contract_schema(df: DataFrame, required: Sequence[str], known_columns: int | None = None,
                    known_rows: int | None = None) -> DataFrame:
    """Missing required columns and, for a known profile, wrong row or column counts."""
    missing = sorted(set(required) - set(df.columns))
    rows = F.count(F.lit(1))
    counts = df.agg(
        F.lit(len(missing)).alias("missing_required_columns"),
        (F.lit(0) if known_rows is None else (rows != known_rows).cast("int")).alias("row_count_mismatch"),
        F.lit(int(known_columns is not None and known_columns != len(df.columns))).alias(
            "column_count_mismatch"
        ),
    )
    return counter_rows(counts).withColumn("detail", F.lit(",".join(missing)))


def contract_identity(meta: DataFrame) -> DataFrame:
    """Every counter of the episode identity contract.

    What a row shows alone is decided first, so only numbers and flags are put in order: once by episode, and
    once inside the source prefix. Repeated indices are rows equal to the one before; repeated ids are
    counted per id. A missing identity value is a finding of its own.
    """
    bounds = ("episode_index", "length", "dataset_from_index", "dataset_to_index")
    fields = global_identity()
    about_episode = every(fields[f] for f in fields if f.startswith("episode_index"))
    about_index = every(fields[f] for f in fields if f.startswith("index"))
    alone = {
        # ids and texts
        "empty_episode_ids": F.coalesce(F.col("episode_id"), F.lit("")) == "",
        "empty_tasks": F.coalesce(F.size("tasks"), F.lit(0)) <= 0,
        "missing_identity_values": ~every(F.col(f"`{c}`").isNotNull() for c in (*bounds, *FILE_COLUMNS)),
        # numbers
        "nonpositive_lengths": F.col("length") <= 0,
        "negative_episode_indices": F.col("episode_index") < 0,
        "negative_file_indices": ~every(F.col(f"`{c}`") >= 0 for c in FILE_COLUMNS),
        "interval_length_mismatches": F.col("dataset_to_index") - F.col("dataset_from_index") != F.col("length"),
        # stored summaries
        "episode_summary_mismatches": ~about_episode,
        "index_location_mismatches": ~about_index,
        "index_std_mismatches": ~close(cell("index", "std"), uniform_std("length")),
    }
    rows = meta.select(
        *bounds, source_prefix("episode_id").alias("source_prefix"), cell("episode_index", "min").alias("_seen_episode"),
        cell("index", "min").alias("_seen_start"), *[F.coalesce(c, F.lit(False)).alias(n) for n, c in alone.items()],
    )
    chained = ordered_scan(
        rows.select("episode_index", "dataset_from_index", "dataset_to_index"), [], ["episode_index", "dataset_from_index"],
        lags={"previous_index": "episode_index", "previous_stop": "dataset_to_index"},
    )
    chain = {
        "duplicate_episode_indices": F.col("episode_index") == F.col("previous_index"),
        "episode_index_gaps": F.col("episode_index") != F.col("previous_index") + 1,
        "interval_chain_breaks": F.col("dataset_from_index") != F.col("previous_stop"),
        "first_start_not_zero": F.col("previous_stop").isNull() & (F.col("dataset_from_index") != 0),
    }
    mismatch = F.col("episode_summary_mismatches") | F.col("index_location_mismatches")
    local = local_numbering(rows.drop("dataset_from_index", "dataset_to_index"))
    as_local = close(F.col("_seen_episode"), F.col("local_episode")) & close(F.col("_seen_start"), F.col("local_start"))
    summaries = {
        "index_any_mismatches": F.col("index_location_mismatches") | F.col("index_std_mismatches"),
        "identity_mismatches": mismatch,
        "identity_mismatches_local_pattern": mismatch & F.coalesce(as_local, F.lit(False)),
    }
    ids = meta.groupBy("episode_id").agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_episode_ids")
    )
    in_order = chained.agg(*[count_true(F.coalesce(c, F.lit(False))).alias(n) for n, c in chain.items()])
    inside = local.agg(*[count_true(F.col(n)).alias(n) for n in alone], *[count_true(c).alias(n) for n, c in summaries.items()])
    return counter_rows(inside.crossJoin(in_order).crossJoin(ids))  # one row each


def uniform_std_check(meta: DataFrame, fps: float) -> DataFrame:
    """Index, frame and time summaries against the closed form of a contiguous run."""
    n, std = F.col("length"), uniform_std("length")
    frame_ok = every(
        [
            close(cell("frame_index", "min"), F.lit(0.0)),
            close(cell("frame_index", "max"), n - 1),
            close(cell("frame_index", "mean"), (n - 1) / 2),
            close(cell("frame_index", "std"), std),
        ]
    )
    time_ok = every(
        [
            close(cell("timestamp", "min"), F.lit(0.0)),
            close(cell("timestamp", "max"), (n - 1) / F.lit(fps)),
            close(cell("timestamp", "mean"), (n - 1) / F.lit(2 * fps)),
            close(cell("timestamp", "std"), std / F.lit(fps)),
        ]
    )
    return violation_counts(
        meta,
        {
            "index_std_mismatches": ~close(cell("index", "std"), std),
            "frame_index_mismatches": ~frame_ok,
            "timestamp_mismatches": ~time_ok,
        },
    )


def constant_task_check(meta: DataFrame) -> DataFrame:
    """Task summaries must be constant inside an episode and hold whole numbers."""
    low, high, std = (cell("task_index", m) for m in ("min", "max", "std"))
    return violation_counts(
        meta,
        {
            "nonconstant_task": ~(close(low, high) & close(std, F.lit(0.0))),
            "nonintegral_task": ~close(low, F.rint(low)),
        },
    )


def first_affected_and_control(findings: DataFrame, bad: str = "identity_bad") -> DataFrame:
    """Lowest mismatching and lowest matching episode per split."""
    return findings.groupBy("split").agg(
        F.min(F.when(F.col(bad), F.col("episode_index"))).alias("first_affected"),
        F.min(F.when(~F.col(bad), F.col("episode_index"))).alias("first_control"),
    )


def declared_totals(meta: DataFrame, tasks: DataFrame, declared: Mapping[str, int]) -> DataFrame:
    """Rows, last frame stop and task rows against declared totals."""
    observed = meta.agg(
        F.count(F.lit(1)).alias("total_episodes"), F.max("dataset_to_index").alias("total_frames")
    ).crossJoin(tasks.agg(F.count(F.lit(1)).alias("total_tasks")))  # one row by one row
    pairs = F.array(
        *[
            F.struct(
                F.lit(n).alias("name"),
                F.lit(int(v)).cast("long").alias("declared"),
                F.col(n).alias("observed"),
            )
            for n, v in declared.items()
        ]
    )
    return observed.select(F.explode(pairs).alias("p")).select(
        "p.*", (F.col("p.declared") == F.col("p.observed")).alias("matches")
    )


def shard_rollup(shard_counters: DataFrame) -> DataFrame:
    """Sum per-shard counters by contract and counter."""
    return shard_counters.groupBy("contract", "counter").agg(
        F.sum("violations").alias("violations"), F.count(F.lit(1)).alias("shards")
    )


# ---- repairs and merges -------------------------------------------------------------------------

SUMMARY_METRICS = ("min", "max", "mean", "std", "count", "q01", "q10", "q50", "q90", "q99")
IDENTITY_SUMMARIES = ("min", "max", "mean", "q01", "q10", "q50", "q90", "q99")


def correct_summary(meta: DataFrame) -> DataFrame:
    """Replace the identity statistics by the constant episode index, keeping each array's shape."""
    present = [
        f"stats/episode_index/{m}"
        for m in IDENTITY_SUMMARIES
        if f"stats/episode_index/{m}" in meta.columns
    ]
    return meta.withColumns(
        {
            name: F.transform(F.col(f"`{name}`"), lambda _: F.col("episode_index").cast("double"))
            for name in present
        }
    )


def merge_offset(meta: DataFrame, episode_offset: int, frame_offset: int,
                 own_tasks: DataFrame, unified_tasks: DataFrame) -> DataFrame:
    """Move a data set behind another one: shift indices and their statistics by constants, and
    look the task index up again in the unified vocabulary by task text."""

    def shifted(name: str, by: int) -> Column:
        return F.transform(F.col(f"`{name}`"), lambda x: x + F.lit(float(by)))

    moved = {}
    for feature, by in (("episode_index", episode_offset), ("index", frame_offset)):
        for m in IDENTITY_SUMMARIES:
            if f"stats/{feature}/{m}" in meta.columns:
                moved[f"stats/{feature}/{m}"] = shifted(f"stats/{feature}/{m}", by)
    out = meta.withColumns(
        {
            **moved,
            "episode_index": F.col("episode_index") + episode_offset,
            "dataset_from_index": F.col("dataset_from_index") + frame_offset,
            "dataset_to_index": F.col("dataset_to_index") + frame_offset,
        }
    )
    out = resolve_reference(out, own_tasks, cell("task_index", "min"), "own_task")
    unified = unified_tasks.select(
        F.col("task").alias("own_task"), F.col("task_index").alias("unified_task_index")
    )
    return out.join(unified, "own_task", "left").drop("lookup_index")


def merge_exposure(findings: DataFrame, merged: Mapping[str, DataFrame], episode_offset: int) -> DataFrame:
    """Identity fields that are wrong after a merge, per condition and kind of record."""
    kinds = findings.select(
        (F.col("episode_index") + episode_offset).alias("episode_index"),
        F.when(F.col("identity_bad"), "affected").otherwise("control").alias("kind"),
    )
    parts = []
    for condition, df in merged.items():
        present = [m for m in IDENTITY_SUMMARIES if f"stats/episode_index/{m}" in df.columns]
        wrong = sum(
            (~close(cell("episode_index", m), F.col("episode_index"))).cast("int") for m in present
        )
        parts.append(
            df.select("episode_index", wrong.alias("wrong_fields")).withColumn("condition", F.lit(condition))
        )
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.join(kinds, "episode_index").groupBy("condition", "kind").agg(
        F.count(F.lit(1)).alias("records"),
        count_true(F.col("wrong_fields") > 0).alias("violating_records"),
        F.sum("wrong_fields").alias("violating_fields"),
    )


def extend_vocabulary(vocabulary: DataFrame, arriving: DataFrame) -> DataFrame:
    """Give unseen tasks the next codes in order of arrival; a repeated known task is an error."""
    known = guard_unique(vocabulary, ["task"])
    fresh = arriving.join(known, "task", "left_anti").groupBy("task").agg(
        F.min("arrival").alias("arrival")
    )
    numbered = ordered_scan(fresh, [], ["arrival", "task"], number="_n")
    base = known.agg(F.coalesce(F.max("task_index"), F.lit(-1)).alias("_base"))
    coded = numbered.crossJoin(base).select(  # base is one row
        "task", (F.col("_base") + F.col("_n")).alias("task_index")
    )
    return known.select("task", "task_index").unionByName(coded)
