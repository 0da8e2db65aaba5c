"""Exact top-k inner products with norm buckets.

Candidates are ordered by length and cut into buckets of consecutive lengths. A query that already has
k scores of at least t needs, from a bucket whose longest vector is l, a cosine of t / (|q| l): its
local threshold. Above 1 the whole bucket is out for the query. Otherwise the bucket is pruned by
length (only vectors with |q| |x| >= t, a prefix of the bucket) or, where the local threshold is high,
by coordinate (|x|'s share on the query's largest coordinate must lie in the interval that the cosine
allows). What is left is verified by its product, in one matrix product per group of queries.

First every query meets the longest bucket, which gives its first t. Then groups of queries meet
groups of buckets; within a group t only rises. Each pair of groups returns at most k rows a query.
The query set is stated (ids divisible by a number) and goes against all rows in blocks of bounded size.

Defined results: vectors that are null, hold null or non-finite components, or have another width than
most are left out; equal scores go to the smaller id; an id that repeats asks once (with its largest
vector) and is never its own answer, and its rows are candidates of their own for others; a zero vector
scores 0; fewer than k candidates give fewer rows; an empty table gives no rows. Finite components of any
size count: rows whose products may pass 2**53 are verified against everything in whole numbers. A score
that is no long is given as the nearest long, and ranked by its true value.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episcope.llm.common import saved
from episcope.session import ship_package

BUCKET, GROUP_BUCKETS, QUERY_BLOCK = 2048, 16, 512
#: At this local threshold and above a bucket is pruned by coordinate, below by length.
COORDINATE_FROM = 0.9

BLOCK_SCHEMA = "block long, ids binary, matrix binary, width int, longest double, largest double"


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """vec_id, x (components as doubles), v (integers as doubles: floor(scale * x)), norm, largest.

    Null and non-finite components leave a vector out. ``largest`` is the largest magnitude in v; where it
    reaches 2**52, v is not to be used.
    """
    x = F.col(vector_col).cast("array<double>")
    good = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & good)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    most = F.lit(float(2**52))
    whole = F.transform("x", lambda c: F.floor(F.greatest(F.least(F.lit(float(scale)) * c, most), -most)).cast("double"))
    rows = rows.withColumn("v", whole)
    rows = rows.withColumn("largest", F.coalesce(F.array_max(F.transform("v", lambda c: F.abs(c))), F.lit(0.0)))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))


_EXACT = "query_id long, vec_id long, score long, beyond string"
#: Where scores do not fit a long, ``beyond`` orders them; all others have this value.
_WITHIN = "5"


def _as_long(score: int) -> tuple[int, str]:
    """The nearest long, and a text that orders scores which are no longs."""
    if -(2**63) <= score < 2**63:
        return score, _WITHIN
    digits = str(abs(score))
    text = f"{len(digits):06d}{digits}"
    if score > 0:
        return 2**63 - 1, f"9{text}"
    return -(2**63), "1" + text.translate(str.maketrans("0123456789", "9876543210"))


def _integers(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as whole numbers of any size."""
    factor = Fraction(scale)
    return np.array([math.floor(Fraction(float(c)) * factor) for c in x], dtype=object)


def _exact_pairs(asked: DataFrame, against: DataFrame, k: int, scale: float, blocks: tuple[int, int]) -> DataFrame:
    """The best ``k`` of ``against`` per row of ``asked`` and block, in whole numbers of any size."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = right.column("vec_id").to_pylist()
        theirs = [_integers(np.array(x), scale) for x in right.column("x").to_pylist()]
        out = []
        for query, x in zip(left.column("vec_id").to_pylist(), left.column("x").to_pylist(), strict=True):
            own = _integers(np.array(x), scale)
            scores = ((-int((own * v).sum()), n) for n, v in zip(names, theirs, strict=True) if n != query)
            out += [(query, n, *_as_long(-s)) for s, n in heapq.nsmallest(k, scores)]
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "vec_id", "score", "beyond"])

    def parted(rows: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
        return rows.select("vec_id", "x", mine.alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    many, few = blocks
    left, right = parted(asked, "q", many, "c", few), parted(against, "c", few, "q", many)
    return left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(meet, _EXACT)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Consecutive rows of each partition as one row per block: ids, a matrix, its longest vector."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, vectors, number = [], [], TaskContext.get().partitionId() << 32

        def block(n: int) -> pa.RecordBatch:
            matrix = np.asarray(vectors[:n], dtype=np.float64)
            longest = float(np.sqrt((matrix * matrix).sum(axis=1)).max())
            return pa.RecordBatch.from_pydict(
                {"block": pa.array([number], pa.int64()), "ids": pa.array([np.asarray(ids[:n], "<i8").tobytes()]),
                 "matrix": pa.array([matrix.tobytes()]), "width": pa.array([matrix.shape[1]], pa.int32()),
                 "longest": pa.array([longest]), "largest": pa.array([float(np.abs(matrix).max(initial=0.0))])}
            )

        for batch in batches:
            new = batch.column("vec_id").to_pylist()
            rows_of = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(new), -1)
            ids += new
            vectors += list(rows_of)
            while len(ids) >= size:
                yield block(size)
                ids, vectors, number = ids[size:], vectors[size:], number + 1
        if ids:
            yield block(len(ids))

    return rows.select("vec_id", "v").mapInArrow(pack, BLOCK_SCHEMA)


class _Bucket:
    def __init__(self, row, exact32: bool):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.matrix = np.frombuffer(row["matrix"], "<f8").reshape(-1, row["width"])
        self.norms = np.sqrt((self.matrix * self.matrix).sum(axis=1))
        order = np.lexsort((self.ids, -self.norms))
        self.ids, self.norms = self.ids[order], self.norms[order]
        self.matrix = self.matrix[order].astype(np.float32 if exact32 else np.float64)


class _Best:
    """The k best (score, id) of each query of a block; hits are gathered and settled in bulk."""

    def __init__(self, ids: np.ndarray, k: int, threshold: np.ndarray):
        self.ids, self.k, self.threshold = ids, k, threshold.copy()
        self.query, self.score, self.name = (np.empty(0, t) for t in (np.int64, np.float64, np.int64))
        self.hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, query: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        keep = name != self.ids[query]
        if keep.any():
            self.hits.append((query[keep], score[keep].astype(np.float64), name[keep]))
            self.waiting += int(keep.sum())
        if self.waiting > 100 * len(self.ids):
            self.settle()

    def settle(self) -> None:
        """Keep the k best of each query; a query's threshold is its k-th score, once it has k."""
        if not self.hits:
            return
        parts = [(self.query, self.score, self.name), *self.hits]
        query, score, name = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((name, -score, query))
        query, score, name = query[order], score[order], name[order]
        first = np.searchsorted(query, query)
        keep = np.arange(len(query)) - first < self.k
        self.query, self.score, self.name = query[keep], score[keep], name[keep]
        self.hits, self.waiting = [], 0
        count = np.bincount(self.query, minlength=len(self.ids))
        last = np.searchsorted(self.query, np.arange(len(self.ids)), side="right") - 1
        enough = count >= self.k
        self.threshold[enough] = np.maximum(self.threshold[enough], self.score[last[enough]])


def _prune(queries: np.ndarray, q_norms: np.ndarray, bucket: _Bucket, threshold: np.ndarray):
    """(queries that still need the bucket, length of the prefix they need, coordinate-pruned ones)."""
    longest = float(bucket.norms[0]) if len(bucket.norms) else 0.0
    reach = q_norms * longest
    alive = (threshold <= reach * (1 + 1e-12)) | ~np.isfinite(threshold)
    rows = np.flatnonzero(alive)
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(reach > 0, threshold / reach, -1.0)
        shortest = np.where((q_norms > 0) & (threshold > 0), threshold / q_norms, 0.0)
    prefix = np.searchsorted(-bucket.norms, -shortest * (1 - 1e-12), side="right")
    by_coordinate = {}
    for q in rows[local[rows] >= COORDINATE_FROM]:
        unit = queries[q] / q_norms[q]
        focus = int(np.abs(unit).argmax())
        cos = min(1.0, max(0.0, local[q] * (1 - 1e-9)))
        spread = np.sqrt(max(0.0, (1 - cos * cos) * (1 - float(unit[focus]) ** 2)))
        centre = float(unit[focus]) * cos
        low, high = centre - spread, (centre + spread if abs(unit[focus]) <= cos else 1.0)
        if unit[focus] < 0:
            low, high = (centre - spread if abs(unit[focus]) <= cos else -1.0), centre + spread
        share = bucket.matrix[: prefix[q], focus] / np.maximum(bucket.norms[: prefix[q]], 1e-300)
        by_coordinate[q] = np.flatnonzero((share >= low - 1e-6) & (share <= high + 1e-6))
    return rows, prefix, by_coordinate


def _meet(queries: np.ndarray, q_norms: np.ndarray, best: _Best, bucket: _Bucket) -> None:
    """Verify what the bucket holds for the queries of a block."""
    rows, prefix, by_coordinate = _prune(queries, q_norms, bucket, best.threshold)
    dense = np.asarray([q for q in rows if q not in by_coordinate], dtype=np.int64)
    if len(dense):
        n = int(prefix[dense].max(initial=0))
        scores = queries[dense].astype(bucket.matrix.dtype) @ bucket.matrix[:n].T
        row, column = np.nonzero(scores >= best.threshold[dense][:, None])
        best.add(dense[row], scores[row, column], bucket.ids[column])
    for q, left in by_coordinate.items():
        scores = bucket.matrix[left] @ queries[q].astype(bucket.matrix.dtype)
        hit = scores >= best.threshold[q]
        best.add(np.full(int(hit.sum()), q), scores[hit], bucket.ids[left[hit]])


def exact_topk(
    vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0,
    id_col: str = "vec_id", vector_col: str = "embedding",
    bucket: int = BUCKET, group_buckets: int = GROUP_BUCKETS, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Best ``k`` candidates by integer inner product for each row whose id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id, score.
    """
    ship_package(vectors.sparkSession)
    rows = integer_vectors(vectors, id_col, vector_col, scale)
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    schema = "query_id long, vec_id long, score long"
    if widths is None or widths["w"] == 0:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = rows.filter(F.size("v") == widths["w"])
    # Rows whose products may pass 2**53 go by whole numbers of any size, against everything.
    limit = math.isqrt((2**53 - 1) // widths["w"])
    everyone = rows
    # Rows that share an id ask once, with the greatest integers.
    asking = everyone.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max_by("x", "v").alias("x"), F.max("v").alias("v"), F.max_by("largest", "v").alias("largest"))
    large = saved(everyone.filter(F.col("largest") > limit).select("vec_id", "x"), "topk-large")
    rows = everyone.filter(F.col("largest") <= limit)
    n_large = large.count()
    extra = None
    if n_large:
        n_asked, n_rows = asking.count(), rows.count()
        size = lambda n: max(1, -(-n // 256))
        hard = asking.filter(F.col("largest") > limit)
        extra = _exact_pairs(asking, large, k, scale, (size(n_asked), size(n_large)))
        extra = extra.unionByName(_exact_pairs(hard, rows.select("vec_id", "x"), k, scale, (size(n_large), size(n_rows))))
        if not n_rows:
            return _ranked(extra, k)
    ranges = rows.repartitionByRange(F.desc("norm"), F.col("vec_id")).sortWithinPartitions(F.desc("norm"), "vec_id")
    buckets = saved(_blocks(ranges, bucket), "topk-buckets")
    asked = asking.filter(F.col("largest") <= limit).select("vec_id", "v")
    queries = saved(_blocks(asked, query_block), "topk-queries")
    largest = buckets.agg(F.max("largest"), F.max("width")).first()
    exact32 = (largest[0] or 0.0) ** 2 * (largest[1] or 1) < 2**24

    # one bucket of at most ``bucket`` vectors, whatever the size of the input
    longest = buckets.orderBy(F.desc("longest"), "block").select("ids", "matrix", "width").first()
    top = vectors.sparkSession.sparkContext.broadcast(longest.asDict())

    def first_thresholds(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket_of = _Bucket(top.value, exact32)
        for frame in blocks:
            starts = []
            for row in frame.to_dict("records"):
                ids = np.frombuffer(row["q_ids"], "<i8")
                matrix = np.frombuffer(row["q_matrix"], "<f8").reshape(len(ids), -1)
                best = _Best(ids, k, np.full(len(ids), -np.inf))
                _meet(matrix, np.sqrt((matrix * matrix).sum(axis=1)), best, bucket_of)
                best.settle()
                starts.append(best.threshold.tobytes())
            yield frame.assign(start=starts)

    asked_blocks = queries.select(
        F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix")
    )
    begun = "q_block long, q_ids binary, q_matrix binary, start binary"
    ready = saved(asked_blocks.mapInPandas(first_thresholds, begun), "topk-started")

    n_buckets = buckets.count()
    groups = max(1, -(-n_buckets // group_buckets))
    dealt = buckets.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    copies = ready.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        held = [_Bucket(r, exact32) for r in right.sort_values("longest", ascending=False).to_dict("records")]
        out = []
        for row in left.to_dict("records"):
            ids = np.frombuffer(row["q_ids"], "<i8")
            matrix = np.frombuffer(row["q_matrix"], "<f8").reshape(len(ids), -1)
            norms = np.sqrt((matrix * matrix).sum(axis=1))
            best = _Best(ids, k, np.frombuffer(row["start"], "<f8"))
            for one in held:
                _meet(matrix, norms, best, one)
            best.settle()
            out.append(
                pd.DataFrame({"query_id": ids[best.query], "vec_id": best.name, "score": best.score.astype(np.int64)})
            )
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    # a cogroup holds at most one slice of query blocks and one group of buckets
    slices = max(1, -(-queries.count() // 8))
    slice_of = F.pmod(F.xxhash64("q_block"), F.lit(slices)).cast("int")
    left = copies.withColumn("slice", slice_of)
    right = dealt.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    found = left.groupBy("part", "slice").cogroup(right.groupBy("part", "slice")).applyInPandas(meet, schema)
    found = found.withColumn("beyond", F.lit(_WITHIN))
    return _ranked(found if extra is None else found.unionByName(extra), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )
