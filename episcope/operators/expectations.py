"""Expectations as boolean columns, compiled into one aggregate per batch.

A suite is a list of ``Expectation``. ``run_suite`` evaluates all of them, per group of ``by``
columns, in one pass (plus one small pass per uniqueness rule). A rule whose columns are missing is
reported as NOT_EXECUTED and never counts as a detection.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episcope.functions import geometry as G
from episcope.functions.columns import count_true
from episcope.operators.conversion import migration_undone
from episcope.operators.frames import clamp, outside
from episcope.operators.ordered import ordered_scan

MAX_DISTINCT_FOR_SET = 20  # fixed value of the fitting rule


@dataclass(frozen=True)
class Expectation:
    """``unexpected`` is true for a row that breaks the rule; ``table`` is a table-level verdict.

    ``scope`` limits a row rule to some rows; ``tag`` is passed on to the results.
    """

    type: str
    kwargs: Mapping[str, object]
    columns: tuple[str, ...] = ()
    unexpected: Callable[[DataFrame], Column] | None = None
    evaluated: Callable[[DataFrame], Column] | None = None
    prepare: Callable[[DataFrame, Sequence[str]], DataFrame] | None = None
    table: Callable[[DataFrame], Column] | None = None
    unique: str | None = None
    scope: Column | None = None
    tag: str = ""

    def runnable(self, df: DataFrame) -> bool:
        return all(c in df.columns for c in self.columns)

    @property
    def kwargs_text(self) -> str:
        """Arguments as JSON; one that is a column is known only when the suite runs."""
        return json.dumps(self.kwargs, sort_keys=True, default=lambda _: "fitted")


RULES: dict[str, Callable[..., Expectation]] = {}


def rule(name: str):
    """Register a maker of expectations under a name."""

    def add(make: Callable[..., Expectation]):
        RULES[name] = make
        return make

    return add


def _missing(df: DataFrame, c: str) -> Column:
    """Null, or NaN in a floating column."""
    floating = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
    return (F.col(c).isNull() | F.isnan(c)) if floating else F.col(c).isNull()


def _row(name: str, c: str, bad: Callable[[], Column], **kwargs) -> Expectation:
    return Expectation(
        name, {"column": c, **kwargs}, (c,),
        unexpected=lambda df: ~_missing(df, c) & bad(), evaluated=lambda df: ~_missing(df, c),
    )


# ---- built-in kinds ------------------------------------------------------------------------------


@rule("columns_match_set")
def columns_match_set(names: Sequence[str], ignore: Sequence[str] = ()) -> Expectation:
    wanted = set(names)
    return Expectation(
        "columns_match_set", {"columns": sorted(wanted)},
        table=lambda df: F.lit(set(df.columns) - set(ignore) == wanted),
    )


@rule("not_null")
def not_null(c: str) -> Expectation:
    return Expectation(
        "not_null", {"column": c}, (c,), unexpected=lambda df: _missing(df, c), evaluated=lambda _: F.lit(True)
    )


@rule("of_type")
def of_type(c: str, type_: str) -> Expectation:
    return Expectation(
        "of_type", {"column": c, "type": type_}, (c,),
        table=lambda df: F.lit(df.schema[c].dataType.simpleString() == type_),
    )


@rule("between")
def between(c: str, low: float | Column | None = None, high: float | Column | None = None) -> Expectation:
    """Bounds are numbers, or columns of the checked rows (such as fitted ones)."""

    def bad() -> Column:
        out = F.lit(False)
        if low is not None:
            out = out | (F.col(c) < F.lit(low))
        if high is not None:
            out = out | (F.col(c) > F.lit(high))
        return out

    return _row("between", c, bad, min=low, max=high)


@rule("row_count_equal")
def row_count_equal(n: int | Column) -> Expectation:
    return Expectation("row_count_equal", {"value": n}, table=lambda _: F.count(F.lit(1)) == n)


@rule("unique")
def unique(c: str) -> Expectation:
    """Every member of a repeated group is unexpected."""
    return Expectation("unique", {"column": c}, (c,), unique=c)


@rule("increasing")
def increasing(c: str, order: Sequence[str]) -> Expectation:
    mark = f"_before_{c}"
    return Expectation(
        "increasing", {"column": c, "order": list(order)}, (c, *order),
        prepare=lambda df, by: ordered_scan(df, by, order, lags={mark: c}),
        unexpected=lambda _: F.coalesce(F.col(c) <= F.col(mark), F.lit(False)),
        evaluated=lambda _: F.col(c).isNotNull(),
    )


@rule("pair_greater")
def pair_greater(a: str, b: str, or_equal: bool = False) -> Expectation:
    ok = (F.col(a) >= F.col(b)) if or_equal else (F.col(a) > F.col(b))
    return Expectation(
        "pair_greater", {"a": a, "b": b, "or_equal": or_equal}, (a, b),
        unexpected=lambda df: ~(_missing(df, a) | _missing(df, b)) & ~ok,
        evaluated=lambda df: ~(_missing(df, a) | _missing(df, b)),
    )


@rule("distinct_in_set")
def distinct_in_set(c: str, values: Sequence) -> Expectation:
    return _row("distinct_in_set", c, lambda: ~F.col(c).isin(list(values)), values=sorted(values))


@rule("values_in_set")
def values_in_set(c: str, values: Sequence) -> Expectation:
    return _row("values_in_set", c, lambda: ~F.col(c).isin(list(values)), values=sorted(values))


@rule("length_equal")
def length_equal(c: str, n: int) -> Expectation:
    return _row("length_equal", c, lambda: F.length(c) != n, value=n)


def _semantic(name: str, columns: Sequence[str], ok: Callable[[], Column], prepare=None, **kwargs) -> Expectation:
    """A rule over several columns; an unknown outcome is unexpected."""
    return Expectation(
        name, {"columns": list(columns), **kwargs}, tuple(columns), prepare=prepare,
        unexpected=lambda _: ~F.coalesce(ok(), F.lit(False)), evaluated=lambda _: F.lit(True),
    )


# ---- semantic kinds ------------------------------------------------------------------------------


@rule("window_selection")
def window_selection() -> Expectation:
    cols = ("absolute_index", "delta_index", "selected_index", "is_pad", "episode_start", "episode_end")

    def ok() -> Column:
        asked = F.col("absolute_index") + F.col("delta_index")
        start, stop = F.col("episode_start"), F.col("episode_end")
        return (F.col("selected_index") == clamp(asked, start, stop)) & (F.col("is_pad") == outside(asked, start, stop))

    return _semantic("window_selection", cols, ok)


@rule("interval_chain")
def interval_chain() -> Expectation:
    cols = ("episode_index", "length", "dataset_from_index", "dataset_to_index")
    return _semantic(
        "interval_chain", cols,
        lambda: (F.col("dataset_to_index") == F.col("_chain_stop"))
        & (F.col("dataset_from_index") == F.col("_chain_stop") - F.col("length")),
        prepare=lambda df, by: ordered_scan(df, by, ["episode_index"], sums={"_chain_stop": "length"}),
    )


@rule("interval_length")
def interval_length() -> Expectation:
    return _semantic(
        "interval_length", ("length", "dataset_from_index", "dataset_to_index"),
        lambda: F.col("dataset_to_index") - F.col("dataset_from_index") == F.col("length"),
    )


@rule("quaternion_convention")
def quaternion_convention(max_error_deg: float = G.ANGLE_TOLERANCE_DEG) -> Expectation:
    target, source = ("qx", "qy", "qz", "qw"), ("source_qw", "source_qx", "source_qy", "source_qz")

    def prepare(df: DataFrame, _) -> DataFrame:
        staged = G.with_unit(df, "_cs", [F.col(c) for c in source])
        return G.with_unit(staged, "_ct", [F.col(c) for c in target])

    def ok() -> Column:
        s, t = ([F.col(f"{n}{i}") for i in range(4)] for n in ("_cs", "_ct"))
        return F.degrees(G.geodesic_atan2(s, "wxyz", t, "xyzw")) <= max_error_deg

    return _semantic("quaternion_convention", (*target, *source), ok, prepare, max_error_deg=max_error_deg)


@rule("instance_converted")
def instance_converted() -> Expectation:
    """A stored quaternion has its scalar part moved from the front to the end."""
    cols = ("source_wxyz", "target_xyzw")
    return _semantic("instance_converted", cols, lambda: migration_undone(F.col("source_wxyz"), F.col("target_xyzw")))


@rule("displacement")
def displacement(rotation: Sequence[Sequence[float]], atol: float = G.DISPLACEMENT_TOLERANCE) -> Expectation:
    delta, seen = ("delta_x", "delta_y", "delta_z"), ("world_delta_x", "world_delta_y", "world_delta_z")

    def ok() -> Column:
        matrix = [[F.lit(float(v)) for v in row] for row in rotation]
        return G.displacement_ok(matrix, [F.col(c) for c in delta], [F.col(c) for c in seen], atol)

    return _semantic("displacement", (*delta, *seen), ok, atol=atol)


@rule("anchor")
def anchor(atol: float = 1e-3) -> Expectation:
    """Only anchor rows are constrained."""

    def ok() -> Column:
        gap = F.abs(F.col("gripper_norm") - F.col("expected_norm"))
        return F.when(F.col("row_kind") == "anchor", ~F.isnan(gap) & (gap <= atol)).otherwise(True)

    return _semantic("anchor", ("row_kind", "gripper_norm", "expected_norm"), ok, atol=atol)


@rule("frame_correspondence")
def frame_correspondence() -> Expectation:
    """Time within half a local interval, and a digest that the expected time allows.

    ``digest_ok`` is the membership flag of ``temporal.in_accepted_set``. A table with a ``|``-joined text
    of allowed digests takes ``frame_correspondence_text``.
    """
    cols = ("returned_seconds", "expected_seconds", "local_interval_seconds", "digest_ok")

    def ok() -> Column:
        gap = F.abs(F.col("returned_seconds") - F.col("expected_seconds"))
        return (gap <= 0.5 * F.col("local_interval_seconds")) & F.col("digest_ok")

    return _semantic("frame_correspondence", cols, ok)


def digest_in_text(digest: Column, allowed: Column) -> Column:
    return F.array_contains(F.split(allowed, r"\|"), digest)


@rule("frame_correspondence_text")
def frame_correspondence_text() -> Expectation:
    """The same rule on a table that stores the allowed digests as one ``|``-joined text per row."""
    cols = ("returned_seconds", "expected_seconds", "local_interval_seconds", "returned_digest", "expected_digests")

    def ok() -> Column:
        gap = F.abs(F.col("returned_seconds") - F.col("expected_seconds"))
        near = gap <= 0.5 * F.col("local_interval_seconds")
        return near & digest_in_text(F.col("returned_digest"), F.col("expected_digests"))

    return _semantic("frame_correspondence_text", cols, ok)


@rule("reference_statistic")
def reference_statistic() -> Expectation:
    cols = ("mean", "std", "reference_mean", "reference_std", "absolute_tolerance")

    def ok() -> Column:
        tol = F.col("absolute_tolerance")
        return (F.abs(F.col("mean") - F.col("reference_mean")) <= tol) & (
            F.abs(F.col("std") - F.col("reference_std")) <= tol
        )

    return _semantic("reference_statistic", cols, ok)


# ---- running -------------------------------------------------------------------------------------


def _seen_value(df: DataFrame, e: Expectation) -> Column:
    """What a rule saw, as an aggregate: the table's own value, or the smallest row that broke the rule."""
    if e.type == "columns_match_set":
        return F.lit(",".join(sorted(df.columns)))
    if e.type == "of_type":
        return F.lit(df.schema[e.columns[0]].dataType.simpleString())
    if e.type == "row_count_equal":
        return F.count(F.lit(1)).cast("string")
    bad = e.unexpected(df) if e.scope is None else e.scope & e.unexpected(df)
    if len(e.columns) == 1:
        return F.min(F.when(bad, F.col(e.columns[0]))).cast("string")
    return F.to_json(F.min(F.when(bad, F.struct(*e.columns))))


def run_suite(
    df: DataFrame, suite: Sequence[Expectation], by: Sequence[str] = (), observed: bool = False
) -> DataFrame:
    """One row per group and expectation:
    ``ordinal, tag, type, kwargs, status, success, unexpected_count, element_count``.

    Several suites on the same rows can share the pass: give each its ``tag`` (and ``scope``). With ``observed``
    a row also tells what the rule saw: the columns, type or row count of the table, or the smallest value
    (of several columns: the smallest row, as JSON) that broke the rule, null if none did. Texts and rows
    among these make Spark sort for the aggregate, so it is not the default.
    """
    by = list(by)
    ready = [e.runnable(df) for e in suite]
    work = df
    for e, ok in zip(suite, ready):
        if ok and e.prepare:
            work = e.prepare(work, by)
    aggs: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    for i, (e, ok) in enumerate(zip(suite, ready)):
        if not ok or e.unique:
            continue
        if observed:
            aggs.append(_seen_value(df, e).alias(f"_o{i}"))
        if e.table is not None:
            aggs.append(F.max(e.table(df)).alias(f"_t{i}") if e.type != "row_count_equal" else e.table(df).alias(f"_t{i}"))
        else:
            bad, seen = e.unexpected(df), e.evaluated(df)
            if e.scope is not None:
                bad, seen = e.scope & bad, e.scope & seen
            aggs += [count_true(bad).alias(f"_u{i}"), count_true(seen).alias(f"_e{i}")]
    one = work.groupBy(*by).agg(*aggs)
    for i, (e, ok) in enumerate(zip(suite, ready)):
        if ok and e.unique:
            one = _join_unique(one, df if e.scope is None else df.where(e.scope), e.unique, i, by)
    rows = []
    for i, (e, ok) in enumerate(zip(suite, ready)):
        counted = ok and e.table is None
        success = "cast(null as boolean)" if not ok else f"_u{i} = 0" if counted else f"_t{i}"
        counts = (f"_u{i}", f"_e{i}") if counted else ("cast(null as bigint)",) * 2
        status = "EXECUTED" if ok else "NOT_EXECUTED"
        texts = ", ".join(_quoted(v) for v in (e.tag, e.type, e.kwargs_text, status))
        rows.append(f"{i}, {texts}, {success}, {', '.join(counts)}")
        if observed:
            rows[-1] += f", _o{i}" if ok else ", cast(null as string)"
    names = "ordinal, tag, type, kwargs, status, success, unexpected_count, element_count" + (", observed" if observed else "")
    return one.select(*by, F.expr(f"stack({len(rows)}, {', '.join(rows)})").alias(*names.split(", ")))


def _quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _join_unique(one: DataFrame, df: DataFrame, c: str, i: int, by: list[str]) -> DataFrame:
    counted = df.where(~_missing(df, c)).groupBy(*by, c).agg(F.count(F.lit(1)).alias("_n"))
    totals = counted.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias(f"_u{i}"),
        F.sum("_n").alias(f"_e{i}"),
        F.min(F.when(F.col("_n") > 1, F.col(c))).cast("string").alias(f"_o{i}"),
    )
    if not by:
        return one.crossJoin(totals)  # one row by one row
    return one.join(totals, by, "left").fillna(0, [f"_u{i}", f"_e{i}"])


def with_verdict(df: DataFrame, expectation: Expectation, by: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: whether the row breaks the rule. For aggregates that ask a rule among other things."""
    work = expectation.prepare(df, list(by)) if expectation.prepare else df
    return work.withColumn(name, expectation.unexpected(df))


def suite_outcome(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Overall success per group: every rule holds; null if a rule could not be evaluated."""
    broken = F.bool_or(F.col("status") != "EXECUTED")
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("expectations"),
        count_true(~F.coalesce("success", F.lit(True))).alias("failed"),
        F.when(broken, F.lit(None).cast("boolean")).otherwise(F.bool_and("success")).alias("success"),
    )


def paired_verdict(outcomes: DataFrame, by: Sequence[str] = ("case", "arm")) -> DataFrame:
    """Verdict per case and arm from the faulty and the reference branch."""
    def branch(name: str) -> Column:
        return F.max(F.when(F.col("branch") == name, F.col("success").cast("int")))

    pair = outcomes.groupBy(*by).agg(branch("faulty").alias("_f"), branch("reference").alias("_r"))
    f, r = F.col("_f"), F.col("_r")
    return pair.withColumn(
        "verdict",
        F.when(f.isNull() | r.isNull(), "NOT_EXECUTED")
        .when((f == 0) & (r == 1), "DETECTED")
        .when((f == 0) & (r == 0), "ALWAYS_FAIL")
        .when((f == 1) & (r == 1), "MISSED")
        .otherwise("REFERENCE_FALSE_POSITIVE_ONLY"),
    ).drop("_f", "_r")


VERDICTS = ("DETECTED", "MISSED", "ALWAYS_FAIL", "REFERENCE_FALSE_POSITIVE_ONLY", "NOT_EXECUTED")


def tally(verdicts: DataFrame) -> DataFrame:
    """Verdict counts by arm."""
    return verdicts.groupBy("arm").agg(
        *[count_true(F.col("verdict") == v).alias(v.lower()) for v in VERDICTS]
    )


def case_matrix(verdicts: DataFrame, arms: Sequence[str]) -> DataFrame:
    """Cases by arms."""
    return verdicts.groupBy("case").pivot("arm", list(arms)).agg(F.first("verdict"))


def coverage_matrix(outcomes: DataFrame, cases: Sequence[str], arms: Sequence[str],
                    branches: Sequence[str] = ("faulty", "reference")) -> DataFrame:
    """Expected (case, arm, branch) keys with how often each ran; one is right."""
    spark = outcomes.sparkSession
    keys = [(c, a, b) for c in cases for a in arms for b in branches]
    wanted = spark.createDataFrame(keys, "case string, arm string, branch string")
    ran = outcomes.groupBy("case", "arm", "branch").agg(F.count(F.lit(1)).alias("_n"))
    return wanted.join(ran, ["case", "arm", "branch"], "left").select(
        "case", "arm", "branch", F.coalesce("_n", F.lit(0)).alias("runs")
    )


# ---- fitting -------------------------------------------------------------------------------------


def fit_suite(fixture: DataFrame) -> list[Expectation]:
    """Parameters from a fixture: column set, presence, type, observed range, small value sets.

    One aggregate for presence and ranges. Value sets come from a distinct-with-limit of 21 rows per
    text column, which bounds what reaches the driver.
    """
    numeric = (T.LongType, T.IntegerType, T.DoubleType, T.FloatType)
    fields = fixture.schema.fields
    aggs = []
    for i, f in enumerate(fields):
        aggs.append(count_true(_missing(fixture, f.name)).alias(f"_m{i}"))
        if isinstance(f.dataType, numeric):
            kept = F.when(~_missing(fixture, f.name), F.col(f.name))
            aggs += [F.min(kept).alias(f"_lo{i}"), F.max(kept).alias(f"_hi{i}")]
    seen = fixture.agg(*aggs).first()
    values = _value_sets(fixture, [f.name for f in fields if not isinstance(f.dataType, numeric)])
    suite = [columns_match_set([f.name for f in fields])]
    for i, f in enumerate(fields):
        if seen[f"_m{i}"] == 0:
            suite.append(not_null(f.name))
        if isinstance(f.dataType, (*numeric, T.BooleanType)):
            suite.append(of_type(f.name, f.dataType.simpleString()))
        if isinstance(f.dataType, numeric):
            if seen[f"_lo{i}"] is not None:
                suite.append(between(f.name, float(seen[f"_lo{i}"]), float(seen[f"_hi{i}"])))
        elif 0 < len(values[f.name]) <= MAX_DISTINCT_FOR_SET:
            boolean = isinstance(f.dataType, T.BooleanType)
            suite.append(distinct_in_set(f.name, [v == "true" if boolean else v for v in values[f.name]]))
    return suite


def fit_parameters(fixture: DataFrame) -> tuple[DataFrame, list[Expectation]]:
    """The same suite without reading the fixture first: a one-row table of parameters, and rules that refer to it.

    Join the row to the checked rows (``F.broadcast``); its columns begin with ``_fit``. A rule that the fixture does
    not support, such as presence of a column with gaps, has an empty scope. Value sets hold 21 texts at most.
    """
    numeric = (T.LongType, T.IntegerType, T.DoubleType, T.FloatType)
    fields = fixture.schema.fields
    aggs, suite, sets = [], [columns_match_set([f.name for f in fields])], []
    for f in fields:
        missing = f"_fit_missing_{f.name}"
        aggs.append(count_true(_missing(fixture, f.name)).alias(missing))
        suite.append(replace(not_null(f.name), scope=F.col(missing) == 0))
        if isinstance(f.dataType, (*numeric, T.BooleanType)):
            suite.append(of_type(f.name, f.dataType.simpleString()))
        if isinstance(f.dataType, numeric):
            kept = F.when(~_missing(fixture, f.name), F.col(f.name))
            low, high = f"_fit_low_{f.name}", f"_fit_high_{f.name}"
            aggs += [F.min(kept).alias(low), F.max(kept).alias(high)]
            suite.append(between(f.name, F.col(low), F.col(high)))
        else:
            values = f"_fit_values_{f.name}"
            some = fixture.where(F.col(f.name).isNotNull()).select(F.col(f.name).cast("string").alias("v")).distinct()
            sets.append(some.limit(MAX_DISTINCT_FOR_SET + 1).agg(F.collect_list("v").alias(values)))
            suite.append(_in_fitted_set(f.name, values))
    row = fixture.agg(*aggs)
    for one in sets:
        row = row.crossJoin(F.broadcast(one))  # one row each
    return row, suite


def _in_fitted_set(c: str, values: str) -> Expectation:
    few = F.size(values).between(1, MAX_DISTINCT_FOR_SET)
    bad = lambda: ~F.array_contains(F.col(values), F.col(c).cast("string"))
    return replace(_row("distinct_in_set", c, bad, values="fitted"), scope=few)


def _value_sets(fixture: DataFrame, names: Sequence[str]) -> dict[str, list[str]]:
    """At most 21 distinct values (as text) of each column, in one job."""
    parts = None
    for n in names:
        some = fixture.where(F.col(n).isNotNull()).select(
            F.lit(n).alias("name"), F.col(n).cast("string").alias("value")
        ).distinct().limit(MAX_DISTINCT_FOR_SET + 1)
        parts = some if parts is None else parts.unionByName(some)
    out: dict[str, list[str]] = {n: [] for n in names}
    for row in parts.collect() if parts is not None else []:
        out[row["name"]].append(row["value"])
    return out


def disjoint_split(df: DataFrame, fit: Column) -> tuple[DataFrame, DataFrame]:
    """Fit rows and validate rows by one fixed rule; a null rule sends a row to the validated side."""
    chosen = F.coalesce(fit, F.lit(False))
    return df.where(chosen), df.where(~chosen)
