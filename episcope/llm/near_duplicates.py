"""Near-duplicate documents with ProbMinHash signatures.

A document is the weighted set of its five-word shingles; the weight is how often a shingle occurs.
Each shingle is a Poisson process of arrivals, with its weight as the rate and a hash of the shingle as
the seed; an arrival falls into one register, and a register keeps the shingle that arrives first. Two
documents agree in a register with the probability Jaccard similarity of their weighted sets. A
shingle is followed only until its next arrival is later than every register of the document, which
ends early for all but the first few.

Registers are cut into bands; documents that agree on a band meet in a bucket. Texts that have the same
words are one node, whatever their number. In a bucket, every node is held against a few centres (the
smallest node under a few orders), not against all others, and the links found give components. What
then still meets in a bucket without being in one component is compared pair by pair in blocks of
bounded size, with signatures first, and with exact similarities where the signatures leave room.

Every link stands on an exact check of probability Jaccard similarity against ``threshold``.

Defined results: texts without words (null and empty ones too) are alone; texts of fewer than five
words are one shingle; rows that share an id keep a row each; the class is named by its smallest id, a
null id names a class only if it has no other; other columns stay behind; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episcope.llm.common import id_and_text, mixed, saved, text_groups
from episcope.llm.components import components

SHINGLE, BANDS, ROWS, ORDERS, BLOCK = 5, 32, 8, 4, 1024
#: Signatures that agree this much less than the threshold rule a pair out (over five standard errors of 256 registers).
MARGIN = 0.13
_WORD = re.compile(r"\w+")
_NODE_BYTES = 16


class _Words(dict):
    """Hash of each word; starts anew past a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            self[word] = value
        return value


_WORDS = _Words()


def shingle_hashes(words: list[str], size: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words; all words if there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(size, len(each))
    total = np.zeros(len(each) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            total = mixed(total + each[j : len(each) - size + 1 + j])
    return total


def weighted_set(text: str, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text in order of their hash, and how often each occurs."""
    return np.unique(shingle_hashes(_WORD.findall(text.lower()), size), return_counts=True)


def signatures(shingles: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, registers: int) -> np.ndarray:
    """ProbMinHash of ``n`` weighted sets at once: in each register the low half of a shingle's hash.

    ``owner`` says which set a shingle belongs to. An arrival's time (as the bits of a positive 32-bit
    float, which sort like the number) and the shingle's low half share one 64-bit word, so that the
    smallest word is the first arrival.
    """
    out = np.full(n * registers, np.iinfo(np.uint64).max, np.uint64)
    seed, rate, who = shingles, weights.astype(np.float64), owner.astype(np.int64)
    low = shingles & np.uint64(0xFFFFFFFF)
    time, step = np.zeros(len(seed)), 0
    while len(seed):
        ahead = int(np.clip(20_000 // len(seed), 1, 128))  # arrivals drawn at once when few are left
        steps = np.arange(step + 1, step + ahead + 1, dtype=np.uint64)
        step += ahead
        with np.errstate(over="ignore"):
            draw = mixed(seed[:, None] + steps * np.uint64(0xD1342543DE82EF95))
        waits = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / rate[:, None]
        times = time[:, None] + np.cumsum(waits, axis=1)
        register = (mixed(draw) % np.uint64(registers)).astype(np.int64) + (who * registers)[:, None]
        packed = (times.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | low[:, None]
        np.minimum.at(out, register.ravel(), packed.ravel())
        latest = (out.reshape(n, registers).max(axis=1) >> np.uint64(32)).astype(np.uint32).view(np.float32)
        latest = np.where(np.isnan(latest), np.inf, latest)
        time = times[:, -1]
        go = time.astype(np.float32) <= latest[who]
        seed, rate, who, low, time = seed[go], rate[go], who[go], low[go], time[go]
    return (out.reshape(n, registers) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key per set and band."""
    rows = signature.shape[1] // bands
    keys = np.zeros((len(signature), bands), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            keys = mixed(keys + signature[:, r::rows][:, :bands].astype(np.uint64))
        return mixed(keys + np.arange(bands, dtype=np.uint64))


def probability_jaccard(a, b) -> float:
    """Exact probability Jaccard similarity of two (shingles, weights), shingles in order.

    A shingle in both adds 1 / sum over all shingles of max(a_j / a_i, b_j / b_i). Sorted by a_j / b_j,
    the sum is a suffix of the a's and a prefix of the b's.
    """
    (xa, wa), (xb, wb) = a, b
    if not len(xa) or not len(xb):
        return 0.0
    _, ia, ib = np.intersect1d(xa, xb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    ca, cb = wa[ia].astype(float), wb[ib].astype(float)
    only_a, only_b = float(wa.sum() - ca.sum()), float(wb.sum() - cb.sum())
    ratio = ca / cb
    order = np.argsort(ratio, kind="stable")
    ratio, ca, cb = ratio[order], ca[order], cb[order]
    after = np.concatenate([[0.0], np.cumsum(ca[::-1])])[::-1]
    before = np.concatenate([[0.0], np.cumsum(cb)])
    cut = np.searchsorted(ratio, ratio, side="left")
    return float((1.0 / ((after[cut] + only_a) / ca + (before[cut] + only_b) / cb)).sum())


def _node_of(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode(), digest_size=_NODE_BYTES).digest()


def _signed(batches: Iterator[pa.RecordBatch], bands: int, registers: int) -> Iterator[pa.RecordBatch]:
    """doc_id, node, signature and band keys of texts; a text without words has no node."""
    for batch in batches:
        for at, texts in text_groups(batch):
            words = [_WORD.findall(t.lower()) for t in texts]
            have = [i for i, w in enumerate(words) if w]
            sets = [np.unique(shingle_hashes(words[i]), return_counts=True) for i in have]
            nodes = [_node_of(w) if w else None for w in words]
            signature: list = [None] * len(texts)
            keys: list = [None] * len(texts)
            if have:
                made = signatures(
                    np.concatenate([s for s, _ in sets]), np.concatenate([w for _, w in sets]),
                    np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets]), len(sets), registers,
                )
                banded = band_keys(made, bands).view(np.int64)
                for row, i in enumerate(have):
                    signature[i], keys[i] = made[row].tobytes(), banded[row]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id")[at : at + len(texts)], "node": pa.array(nodes, pa.binary()),
                 "signature": pa.array(signature, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64()))}
            )


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and its weighted set, as two binary columns."""
    for batch in batches:
        for _, texts in text_groups(batch):
            words = [_WORD.findall(t.lower()) for t in texts]
            sets = [np.unique(shingle_hashes(w), return_counts=True) for w in words]
            yield pa.RecordBatch.from_pydict(
                {"node": pa.array([_node_of(w) for w in words], pa.binary()),
                 "shingles": pa.array([s.tobytes() for s, _ in sets], pa.binary()),
                 "weights": pa.array([w.astype(np.uint32).tobytes() for _, w in sets], pa.binary())}
            )


def _set(shingles: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(shingles, np.uint64), np.frombuffer(weights, np.uint32)


def _checked(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose exact similarity reaches the threshold."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("a", "b", "sa", "wa", "sb", "wb")]
        rows = [
            (a, b, s)
            for a, b, sa, wa, sb, wb in zip(*columns, strict=True)
            if (s := probability_jaccard(_set(sa, wa), _set(sb, wb))) >= threshold - 1e-9
        ]
        a, b, s = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_pydict(
            {"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "similarity": pa.array(s, pa.float64())}
        )


def _block_pair(members: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between nodes of one or two blocks of a bucket that are in different components.

    Compares signatures first; checks exactly where they leave room; a link joins two components, so
    only pairs that are still apart are looked at.
    """
    members = members.drop_duplicates("node").reset_index(drop=True)
    names = members["label"].tolist()
    parent = {n: n for n in names}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    signature = np.frombuffer(b"".join(members["signature"]), np.uint32).reshape(len(members), -1)
    sets = [None] * len(members)
    links = []
    for i in range(len(members) - 1):
        agree = (signature[i + 1 :] == signature[i]).mean(axis=1)
        for j in np.flatnonzero(agree >= threshold - MARGIN) + i + 1:
            if root(names[i]) == root(names[j]):
                continue
            for k in (i, j):
                if sets[k] is None:
                    sets[k] = _set(members["shingles"][k], members["weights"][k])
            if (s := probability_jaccard(sets[i], sets[j])) >= threshold - 1e-9:
                links.append((members["node"][i], members["node"][j], s))
                parent[root(names[i])] = root(names[j])
    return pd.DataFrame(links, columns=["a", "b", "similarity"])


def near_duplicate_classes(
    docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, class_id (the smallest id of the class), kept (True for one row of each class)."""
    texts = id_and_text(docs, id_col, text_col)
    schema = "doc_id long, node binary, signature binary, keys array<long>"
    signed = texts.mapInArrow(partial(_signed, bands=bands, registers=bands * rows), schema)
    signed = saved(signed, "near-signed")
    nodes = signed.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.any_value("signature").alias("signature"), F.any_value("keys").alias("keys"),
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"),
    )
    nodes = saved(nodes, "near-nodes")

    # buckets of two nodes or more, with their centres: the smallest node under one of a few orders per band
    met = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    rank = F.struct(F.xxhash64("node", F.col("band") % ORDERS).alias("order"), F.col("node").alias("node"))
    centres = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("centre"))
    centres = centres.filter("n > 1").select("key", "n", F.col("centre.node").alias("centre"))
    buckets = saved(met.select("node", "key").join(centres, "key"), "near-buckets")
    pairs = buckets.filter("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    pairs = saved(pairs.distinct(), "near-pairs")

    # weighted sets of the nodes that are in a bucket, from the texts
    wanted = buckets.select("node").distinct()
    ids = nodes.join(wanted, "node", "left_semi").select(F.col("first").alias("doc_id"))
    chosen = texts.join(ids.distinct(), "doc_id", "left_semi") if _unique_ids(signed) else texts
    sets = chosen.filter("text <> ''").select("text").mapInArrow(_sets_of, "node binary, shingles binary, weights binary")
    sets = sets.join(wanted, "node", "left_semi").groupBy("node").agg(
        F.any_value("shingles").alias("shingles"), F.any_value("weights").alias("weights")
    )
    sets = saved(sets, "near-sets")

    side = lambda n: sets.select(F.col("node").alias(n), F.col("shingles").alias(f"s{n}"), F.col("weights").alias(f"w{n}"))
    loaded = pairs.join(side("a"), "a").join(side("b"), "b")
    linked = "a binary, b binary, similarity double"
    links = saved(loaded.mapInArrow(partial(_checked, threshold=threshold), linked), "near-links")
    labels = components(links)

    # buckets that still hold more than one component: all pairs across components, block by block
    labelled = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_keys = labelled.filter("n > 2").groupBy("key").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("members")
    )
    open_keys = open_keys.filter("lo <> hi").select("key", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    rest = labelled.select("key", "node", "label").join(open_keys, "key")
    rest = rest.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select(
        "key", "node", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )
    rest = rest.join(nodes.select("node", "signature"), "node").join(sets, "node")

    def apart(members: pd.DataFrame) -> pd.DataFrame:
        return _block_pair(members, threshold)

    more = saved(rest.groupBy("key", "i", "j").applyInPandas(apart, linked), "near-more")
    if more.limit(1).count():
        labels = components(links.unionByName(more))

    named = signed.select("doc_id", "node").join(labels, "node", "left")
    named = named.withColumn("label", F.coalesce("label", "node"))
    first = named.filter(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("class_id"))
    out = named.join(first, "label", "left").select(
        "doc_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.col("label").isNull().alias("alone"),
    )
    return out.select("doc_id", "class_id", (F.col("alone") | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))


def _unique_ids(signed: DataFrame) -> bool:
    """True if no id stands for two texts with words (then a node's smallest id finds its text)."""
    named = signed.filter(F.col("node").isNotNull())
    shared = named.groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    return not shared.filter(F.col("doc_id").isNull() | (F.col("lo") != F.col("hi"))).limit(1).count()


def keep_one_of_each(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` without those that are near duplicates of a kept one; columns stay as they are.

    Rows are told apart by id; of rows that share an id with the kept row, all stay, and so does every row
    without an id.
    """
    classes = near_duplicate_classes(docs, threshold, id_col=id_col, text_col=text_col)
    gone = classes.groupBy(F.col("doc_id").alias(id_col)).agg(F.max("kept").alias("kept")).filter("not kept").select(id_col)
    return docs.join(gone, id_col, "left_anti")
