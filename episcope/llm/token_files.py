"""Token ids in files of fixed-width bit fields.

Ids take the fewest bits that hold the vocabulary. A file is a table of blocks, one row each: the
packed ids, the field width, where the block starts in its shard, and the documents in it with their
lengths. Eight fields of ``bits`` bits fill exactly ``bits`` bytes, so packing and unpacking are eight
strided numpy operations, and any field is found by its offset alone. Blocks end at a document's end.

Blocks are Parquet rows, so that writing is atomic per task, works on every file system Spark knows,
and a lost executor only repeats its shard.

Defined results: a null or empty text has the end id only; documents that share an id keep their rows,
in a fixed order (by the text within a shard, by its hash across the end of one); a null id comes first; an empty table gives an empty file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from episcope.llm.common import id_and_text, text_groups
from episcope.llm.encoders import encoder, vocabulary_size

BLOCK_IDS = 1 << 16
BLOCK_SCHEMA = (
    "shard int, block int, bits int, first long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"
)


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold the ids 0 to ``vocabulary`` - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Fields of ``bits`` bits, lowest bit first, without gaps; the last byte is filled with zeros."""
    n = len(ids)
    lanes = np.zeros((-(-n // 8), 8), dtype=np.uint64)
    lanes.reshape(-1)[:n] = ids
    out = np.zeros((len(lanes), bits), dtype=np.uint8)
    for j in range(8):
        byte, shift = divmod(j * bits, 8)
        value = lanes[:, j] << np.uint64(shift)
        for k in range(-(-(shift + bits) // 8)):
            out[:, byte + k] |= ((value >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)
    return out.tobytes()[: -(-n * bits // 8)]


def unpack_bits(payload: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` fields from field ``first`` on, as unsigned 32-bit integers."""
    group = first // 8
    groups = -(-(first + count) // 8) - group
    part = payload[group * bits : (group + groups) * bits]
    raw = np.zeros(groups * bits, dtype=np.uint8)
    raw[: len(part)] = np.frombuffer(part, dtype=np.uint8)
    raw = raw.reshape(groups, bits)
    lanes = np.empty((groups, 8), dtype=np.uint32)
    keep = np.uint64((1 << bits) - 1)
    for j in range(8):
        byte, shift = divmod(j * bits, 8)
        value = np.zeros(groups, dtype=np.uint64)
        for k in range(-(-(shift + bits) // 8)):
            value |= raw[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        lanes[:, j] = (value >> np.uint64(shift)) & keep
    start = first - group * 8
    return lanes.reshape(-1)[start : start + count]


def write_token_file(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode every text, append ``end_id``, and write all ids in ascending order of the document id.

    One range shuffle of the texts puts them in order; each task then encodes and packs its shard.
    """
    bits = bits_for(max(vocabulary_size(tokenizer), end_id + 1))
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        names, lengths, held = [], [], []

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "block": pa.array([number], pa.int32()),
                 "bits": pa.array([bits], pa.int32()), "first": pa.array([first], pa.int64()),
                 "n_ids": pa.array([len(ids)], pa.int64()), "doc_ids": pa.array([names], pa.list_(pa.int64())),
                 "lengths": pa.array([lengths], pa.list_(pa.int64())),
                 "payload": pa.array([pack_bits(ids, bits)], pa.binary())}
            )

        size = 0
        for batch in batches:
            for at, texts in text_groups(batch):
                encoded = encoder(tokenizer).encode(texts)
                for name, ids in zip(batch.column("doc_id")[at : at + len(texts)].to_pylist(), encoded, strict=True):
                    names.append(name)
                    lengths.append(len(ids) // 4 + 1)
                    held += [ids, end]
                    size += lengths[-1]
                    if size >= block_ids:
                        yield block()
                        number, first, size = number + 1, first + size, 0
                        names, lengths, held = [], [], []
        if names:
            yield block()

    (
        id_and_text(docs, id_col, text_col)
        .repartitionByRange(F.col("doc_id"), F.xxhash64("text"))
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(blocks, BLOCK_SCHEMA)
        .write.parquet(path)
    )


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """Where each shard starts in the whole file: a row per shard, so a running sum over few rows."""
    totals = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of the file: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked, ids.

    The checksum is taken over all ids as little-endian unsigned 32-bit integers.
    """
    kept = "doc_id long, shard int, place long, n_tokens long, ids_crc32 long"
    kept += ", ids array<int>" if with_ids else ""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                sizes = np.asarray(block["lengths"], dtype=np.int64)
                at = np.concatenate([[0], np.cumsum(sizes)])
                ids = unpack_bits(block["payload"], block["bits"], 0, block["n_ids"]).astype("<u4")
                out = {
                    "doc_id": pa.array(block["doc_ids"], pa.int64()),
                    "shard": pa.array([block["shard"]] * len(sizes), pa.int32()),
                    "place": pa.array(block["first"] + at[:-1], pa.int64()),
                    "n_tokens": pa.array(sizes, pa.int64()),
                    "ids_crc32": pa.array(
                        [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()
                    ),
                }
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view("<i4"), pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    columns = ["shard", "bits", "first", "n_ids", "doc_ids", "lengths", "payload"]
    found = spark.read.parquet(path).select(columns).mapInArrow(documents, kept)
    placed = found.join(F.broadcast(shard_starts(spark, path)), "shard")  # a row per shard
    rest = ["n_tokens", "ids_crc32"] + (["ids"] if with_ids else [])
    return placed.select("doc_id", (F.col("shard_start") + F.col("place")).alias("start"), *rest)


def read_range(spark: SparkSession, path: str, start: int, count: int) -> DataFrame:
    """Random access: rows (position, id) of the ids ``start`` to ``start + count`` - 1 of the whole file.

    Only blocks that overlap the range are read, and only its fields are unpacked.
    """
    starts = F.broadcast(shard_starts(spark, path))  # a row per shard
    place = F.col("shard_start") + F.col("first")
    hit = (
        spark.read.parquet(path).join(starts, "shard").withColumn("place", place)
        .filter((F.col("place") < start + count) & (F.col("place") + F.col("n_ids") > start))
        .select("place", "n_ids", "bits", "payload")
    )

    def fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                a, b = max(start, block["place"]), min(start + count, block["place"] + block["n_ids"])
                ids = unpack_bits(block["payload"], block["bits"], a - block["place"], b - a)
                yield pa.RecordBatch.from_pydict(
                    {"position": pa.array(np.arange(a, b), pa.int64()), "id": pa.array(ids.astype(np.int64), pa.int64())}
                )

    return hit.mapInArrow(fields, "position long, id long")
