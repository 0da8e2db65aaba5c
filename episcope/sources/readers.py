"""Reading episode, frame and companion tables, and checks on what was read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episcope.operators.expectations import Expectation, not_null, of_type

IDENTITY = ("episode_index", "task_index", "frame_index", "index")


def read_episodes(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """All metadata shards under ``paths``, only the columns asked for."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.parquet(*paths)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the shards: {missing}")
    return df.select(*[f"`{c}`" for c in columns])


def read_frames(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] = IDENTITY) -> DataFrame:
    """Identity columns of the frame files; media columns are never read."""
    return read_episodes(spark, paths, columns)


def identity_guard(columns: Sequence[str], type_: str = "bigint") -> list[Expectation]:
    """Identity columns must be present whole numbers."""
    return [e for c in columns for e in (not_null(c), of_type(c, type_))]


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Files as ``(path, content)`` for digest checks."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Episode or task lists, one JSON object per line."""
    return spark.read.schema(schema).json(path)


def read_json_document(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A companion document such as info or statistics, one object per file."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path, multiLine=True)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON documents of unknown shape as ``(file, document)``, the document as VARIANT."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.parse_json("value").alias("document")
    )


def document_entries(df: DataFrame, document: str, at: str = "$") -> DataFrame:
    """The members of the JSON object at a path: rows ``(..., name, entry)``; none where it is no object."""
    here = F.try_variant_get(document, at, "variant")
    members = F.when(F.schema_of_variant(here).startswith("OBJECT"), here.cast("map<string, variant>"))
    return df.select(*[c for c in df.columns if c != document], F.explode(members).alias("name", "entry"))


def document_values(df: DataFrame, value: str, depth: int = 4) -> DataFrame:
    """Numbers of arrays nested up to ``depth`` levels: rows ``(..., position, number)``.

    ``position`` joins the places of all levels by ``/`` (empty for a plain number). What is no number
    gives a null.
    """
    keep = [c for c in df.columns if c != value]
    rows = df.select(*keep, F.lit("").alias("position"), F.col(value).alias("_v"))
    for _ in range(depth):
        nested = F.schema_of_variant("_v").startswith("ARRAY")
        inner = F.when(nested, F.col("_v").cast("array<variant>")).otherwise(F.array("_v"))
        rows = rows.select(*keep, "position", nested.alias("_nested"), F.posexplode(inner).alias("_at", "_v"))
        step = F.concat(F.when(F.col("position") != "", F.concat("position", F.lit("/"))).otherwise(""), F.col("_at").cast("string"))
        rows = rows.select(*keep, F.when(F.col("_nested"), step).otherwise(F.col("position")).alias("position"), "_v")
    return rows.select(*keep, "position", F.try_variant_get("_v", "$", "double").alias("number"))


def json_entries(df: DataFrame, text: str, value_type: str = "bigint") -> DataFrame:
    """Explode a column of JSON objects to rows ``(..., name, value)``."""
    parsed = F.from_json(F.col(text), f"map<string,{value_type}>")
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.explode(parsed).alias("name", "value"))


@dataclass(frozen=True)
class Cell:
    """A wide column named ``group/name/field``; the name itself may hold slashes."""

    column: str
    group: str
    name: str
    field: str

    @classmethod
    def parse(cls, column: str) -> Cell | None:
        group, _, rest = column.partition("/")
        name, _, field = rest.rpartition("/")
        return cls(column, group, name, field) if group and name and field else None

    def value(self) -> Column:
        return F.col("`" + self.column.replace("`", "``") + "`")


def cells_of(df: DataFrame, group: str) -> list[Cell]:
    """The wide columns of one group."""
    parsed = map(Cell.parse, df.columns)
    return [c for c in parsed if c is not None and c.group == group]


def long_features(df: DataFrame, keys: Sequence[str], group: str = "stats") -> DataFrame:
    """Wide statistics columns to rows ``(keys, feature, metric, value)``."""
    rows = [
        F.struct(F.lit(c.name).alias("feature"), F.lit(c.field).alias("metric"), c.value().alias("value"))
        for c in cells_of(df, group)
    ]
    return df.select(*keys, F.inline(F.array(*rows)))


SEGMENT_FIELDS = ("chunk_index", "file_index", "from_timestamp", "to_timestamp")


def long_cameras(df: DataFrame, keys: Sequence[str], group: str = "videos") -> DataFrame:
    """Wide per-camera columns to rows ``(keys, camera, chunk_index, file_index, from, to)``.

    A camera is any name of the group that has all of SEGMENT_FIELDS.
    """
    by_camera: dict[str, dict[str, Column]] = {}
    for c in cells_of(df, group):
        by_camera.setdefault(c.name, {})[c.field] = c.value()
    rows = [
        F.struct(F.lit(camera).alias("camera"), *[fields[f].alias(f) for f in SEGMENT_FIELDS])
        for camera, fields in by_camera.items()
        if fields.keys() >= set(SEGMENT_FIELDS)
    ]
    return df.select(*keys, F.inline(F.array(*rows)))


def data_file_inventory(episodes: DataFrame) -> DataFrame:
    """Distinct data files that episodes refer to, with episode and frame totals."""
    return episodes.groupBy(
        "split", F.col("`data/chunk_index`").alias("chunk_index"), F.col("`data/file_index`").alias("file_index")
    ).agg(F.count(F.lit(1)).alias("episodes"), F.sum("length").alias("frames"))


def budgeted_sample(files: DataFrame, key: str, size: str, budget: int, seed: int) -> DataFrame:
    """Fixed pseudo-random order of files; keep them up to the first that would pass the budget.

    Every file is listed; ``kept`` says on which side it fell and ``running_size`` why.
    """
    from episcope.operators.ordered import ordered_scan

    drawn = files.withColumn("_draw", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))
    run = ordered_scan(drawn, [], ["_draw", key], number="draw_order", sums={"running_size": size})
    return run.withColumn("kept", F.col("running_size") <= budget).drop("_draw")


def merge_episode_metadata(legacy: DataFrame, offsets: DataFrame, segments: DataFrame, stats: DataFrame,
                           key: str = "episode_index") -> tuple[DataFrame, DataFrame]:
    """Join the four sources of an episode row on its index.

    Returns the merged rows and the mismatches: ids that not all four sources have.
    """
    sources = {"legacy": legacy, "offsets": offsets, "segments": segments, "stats": stats}
    merged = None
    for df in sources.values():
        merged = df if merged is None else merged.join(df, key)
    tagged = None
    for name, df in sources.items():
        part = df.select(key, F.lit(name).alias("source"))
        tagged = part if tagged is None else tagged.unionByName(part)
    mismatches = (
        tagged.groupBy(key)
        .agg(*[F.max((F.col("source") == n).cast("int")).alias(n) for n in sources])
        .where(" + ".join(sources) + f" < {len(sources)}")
        .select(key, F.array_join(F.array_compact(F.array(*[F.when(F.col(n) == 0, n) for n in sources])), ",").alias("absent_from"))
    )
    return merged, mismatches
