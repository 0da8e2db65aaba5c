"""Near-duplicate vectors: cross-polytope hashing with multiprobe buckets, and verified pairs.

A vector is rotated at random by three rounds of sign flips and fast Hadamard transforms, and hashed to the
nearest of the 2d signed axes. ``width`` such hashes name a bucket of a table; each vector also enters the
``probes`` buckets that it misses most narrowly. All vectors of a bucket are compared by exact cosine.
``width`` follows the number of vectors (about sixteen cells a vector), and the number of tables follows from
the chance that two vectors at the threshold meet in one, measured on drawn pairs of that cosine.

Verified pairs of buckets give components. Links are then counted within components, where every pair
is a candidate and is verified once, so a vector's number of links does not depend on which bucket
showed which pair. A bucket or component of any size is dealt into blocks of about 768 vectors, and pairs of
blocks go to tasks as matrix products; only forests and counts leave a task, never the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope.llm.common import mixed, saved
from episcope.llm.components import components
from episcope.llm.keyed import whole
from episcope.session import ship_package

_BLOCK = 768
_SEED = 0x5EED


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of every row (a power of two long), scaled to keep lengths."""
    size, half = rows.shape[1], 1
    out = rows
    while half < size:
        pairs = out.reshape(len(rows), -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(rows), size)
        half *= 2
    return out / np.sqrt(size)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths; scaled first, so that huge and tiny components keep their direction."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def axes_of(dim: int) -> int:
    """The dimension rotated in: a power of two, at least 16, so that sign flips suffice for a random turn."""
    return max(16, 1 << max(dim - 1, 0).bit_length())


def codes(units: np.ndarray, table: int, width: int, probes: int) -> np.ndarray:
    """Bucket numbers of every row in a table: the own one first, then the nearest others."""
    count, dim = units.shape
    size = axes_of(dim)
    padded = np.zeros((count, size))
    padded[:, :dim] = units
    keep = min(3, 2 * size)
    axis, loss = np.empty((width, count, keep), np.int64), np.empty((width, count, keep))
    for number in range(width):
        rng = np.random.default_rng([_SEED, size, table, number])
        turned = padded
        for _ in range(3):
            turned = hadamard(turned * rng.choice([-1.0, 1.0], size))
        both = np.concatenate([turned, -turned], 1)
        near = np.argpartition(-both, keep - 1, axis=1)[:, :keep]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(both, near, 1), axis=1, kind="stable"), 1)
        high = np.take_along_axis(both, near, 1)
        axis[number], loss[number] = near, (high[:, :1] - high) ** 2
    moves = [{}]  # which hashes take another axis than the nearest
    moves += [{i: r} for i in range(width) for r in range(1, keep)]
    moves += [{i: r, j: q} for i, j in combinations(range(width), 2) for r in range(1, keep) for q in range(1, keep)]
    lost = np.stack([sum((loss[i, :, r] for i, r in m.items()), np.zeros(count)) for m in moves], 1)
    order = np.argsort(lost[:, 1:], axis=1, kind="stable")[:, :probes] + 1
    chosen = np.concatenate([np.zeros((count, 1), np.int64), order], 1)
    ranks = np.array([[m.get(i, 0) for i in range(width)] for m in moves])[chosen]  # row, bucket, hash
    name = np.full(chosen.shape, (dim << 32) + table, np.uint64)
    for i in range(width):
        name = mixed(name ^ np.take_along_axis(axis[i], ranks[:, :, i], 1).astype(np.uint64))
    return name.view(np.int64)


def tables_for(dim: int, width: int, probes: int, threshold: float, recall: float, drawn: int = 800) -> int:
    """Tables after which two vectors at the threshold have met with probability ``recall``.

    The chance of one table is measured on drawn pairs of that cosine; tables are independent.
    """
    rng = np.random.default_rng([_SEED, dim])
    a, away = unit(rng.normal(size=(drawn, dim))), rng.normal(size=(drawn, dim))
    away -= (away * a).sum(1, keepdims=True) * a
    length = np.sqrt((away * away).sum(1, keepdims=True))
    b = a if dim < 2 else threshold * a + np.sqrt(1 - threshold**2) * away / length
    met = []
    for table in range(4):
        left, right = codes(a, table, width, probes), codes(b, table, width, probes)
        met.append((left[:, :1] == right).any(1) | (left == right[:, :1]).any(1))
    chance = min(max(float(np.mean(met)), 0.01), 0.99)
    return int(np.ceil(np.log(1 - recall) / np.log(1 - chance))) + 1


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def _dealt(members: DataFrame, group: str) -> DataFrame:
    """Rows of ``members`` (group, size of the group, node, copies, vector) for every pair of blocks of a group."""
    blocks = F.ceil(F.col("size") / _BLOCK).cast("int")
    rows = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    rows = rows.select(
        F.col(group).alias("key"), low.alias("low"), high.alias("high"), (F.col("own") != low).alias("right"), "node", "copies", "vector"
    )
    return rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "right")


def _compared(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[tuple]:
    """Per pair of blocks: nodes and copies of both sides, and which rows are linked."""
    for (_, low, high), rows in whole(batches, ["key", "low", "high"]):
        node = rows.column("node").to_numpy()
        copies = rows.column("copies").to_numpy()
        units = unit(_vectors(rows.column("vector")))
        if low == high:
            linked = units @ units.T >= threshold
            np.fill_diagonal(linked, False)
            linked &= node[:, None] != node[None, :]
            yield node, copies, node, copies, linked, True
            continue
        right = np.asarray(rows.column("right").to_numpy(zero_copy_only=False), bool)
        if right.any() and not right.all():
            yield node[~right], copies[~right], node[right], copies[right], units[~right] @ units[right].T >= threshold, False


def _forest(threshold: float):
    """Links of a pair of blocks, thinned to a forest with the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, _, right, _, linked, _ in _compared(batches, threshold):
            parent: dict[int, int] = {}

            def root(x: int, parent=parent) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            found = []
            for i, row in enumerate(linked):
                for b in right[np.flatnonzero(row)].tolist():
                    x, y = root(int(left[i])), root(b)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        found.append((int(left[i]), b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"]
            )

    return run


def _counts(threshold: float):
    """How many vectors every node is linked with, per pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, left_copies, right, right_copies, linked, same in _compared(batches, threshold):
            node, links = left, linked.astype(np.int64) @ right_copies
            if not same:
                node = np.concatenate([left, right])
                links = np.concatenate([links, linked.T.astype(np.int64) @ left_copies])
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(links, pa.int64())], names=["node", "links"])

    return run


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0.0), F.lit(False))


def _memberships(nodes: DataFrame, threshold: float, probes: int, recall: float) -> DataFrame:
    """bucket, node, home: the buckets of every node."""
    about = nodes.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    count, dim = about["n"], about["dim"] or 1
    cells, width = 2 * axes_of(dim), 1
    while cells**width < 16 * count:
        width += 1
    tables = tables_for(dim, width, probes, threshold, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy()
            for size in np.unique(sizes):
                rows = batch.filter(pa.array(sizes == size))
                for start in range(0, rows.num_rows, 1024):
                    piece = rows.slice(start, 1024)
                    units, node = unit(_vectors(piece.column("vector"))), piece.column("node").to_numpy()
                    for table in range(tables):
                        bucket = codes(units, table, width, probes)
                        home = np.zeros(bucket.shape, bool)
                        home[:, 0] = True
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(bucket.ravel()), pa.array(np.repeat(node, bucket.shape[1])), pa.array(home.ravel())],
                            names=["bucket", "node", "home"],
                        )

    return nodes.select("node", "vector").mapInArrow(run, "bucket long, node long, home boolean")


def vector_links(
    vectors: DataFrame,
    threshold: float = 0.95,
    probes: int = 4,
    recall: float = 0.999,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``.

    ``n_links`` counts the other rows whose vector has a cosine of at least ``threshold``;
    ``component_id`` is the smallest id that links reach, and ``kept`` marks the row that has it. Equal
    vectors are hashed and compared once, with their number. ``recall`` is the chance that one pair at the
    threshold meets in a bucket; pairs above it meet more surely, and within a component all pairs are counted.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do rows
    without an id (their component is null, and they are kept). Vectors of different sizes do not link. Rows
    that repeat, also with one id, are answered and counted each. An empty table gives none. Other columns
    are left behind.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    usable = F.col("vec_id").isNotNull() & _usable(F.col("vector"))
    rows = rows.select(
        "vec_id",
        F.when(usable, F.xxhash64("vector")).alias("h1"),
        F.when(usable, F.xxhash64(F.lit(_SEED), "vector")).alias("h2"),
        "vector",
    )
    nodes = rows.filter("h1 is not null").groupBy("h1", "h2").agg(
        F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("least")
    )
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")

    found = saved(_memberships(nodes, threshold, probes, recall), "buckets")
    crowded = found.groupBy("bucket").agg(F.count("*").alias("size"), F.max("home").alias("home"))
    crowded = crowded.filter("size > 1 and home").drop("home")
    members = found.drop("home").join(crowded, "bucket").join(nodes.select("node", "copies", "vector"), "node")
    links = _dealt(members, "bucket").mapInArrow(_forest(threshold), "a long, b long")
    labels = components(saved(links, "vector-links"))

    labelled = nodes.join(labels, "node")
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    counted = _dealt(labelled.join(sizes, "label"), "label").mapInArrow(_counts(threshold), "node long, links long")
    counted = counted.groupBy("node").agg(F.sum("links").alias("links"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    answers = labels.join(least, "label").join(counted, "node").select("node", "links", "component_id")
    answers = nodes.select("h1", "h2", "node", "copies", "least").join(answers, "node", "left").select(
        "h1", "h2", "copies",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "least").alias("component_id"),
    )
    answers = saved(answers, "vector-answers")

    # A vector with more than a thousandth of all rows has under a thousand peers: those few are broadcast.
    total = nodes.agg(F.sum("copies")).first()[0] or 0
    narrow = rows.select("vec_id", "h1", "h2")
    common = answers.filter(F.col("copies") * 1000 > total).select("h1", "h2", F.col("n_links"), F.col("component_id"), F.lit(True).alias("found"))
    first = narrow.join(F.broadcast(common), ["h1", "h2"], "left")
    columns = ["vec_id", "n_links", "component_id"]
    hot = first.filter("found").select(columns)
    usual = first.filter("found is null and h1 is not null").select("vec_id", "h1", "h2")
    usual = usual.join(answers.filter(F.col("copies") * 1000 <= total), ["h1", "h2"]).select(columns)
    apart = first.filter("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = hot.unionByName(usual).unionByName(apart)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
