import os
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from episcope.llm import packing, queries, token_counts, token_files
from episcope.session import scratch_folder

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
SCHEMA = "doc_id long, text string, start string, length string"
HARD = [
    (5, None), (1, ""), (1, "same id, other text"), (None, "no id"), (2, "A  b\n\n\tc\r\nd"), (2, "A  b\n\n\tc\r\nd"),
    (3, "<|endoftext|> in <|startoftext|>text<|endoftext|><|endoftext|>"), (4, "ΑΣ ΑΣΑ ①② ½ é ́x ​q w e \x1c\x1d z"),
    (6, "word " * 6000), (7, "x" * 9000), (8, "don't we'll ''s '' 'S it's  \n  end  "), (9, "日本語 text 🙂🙂 mixed_under __ 1234 ٣٤ Ⅷ"),
]


def hard(spark):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in HARD], SCHEMA)


def everything(spark, sf_dir="/root/testdata/sf0.001"):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@given(st.integers(1, 31), st.lists(st.integers(0, 2**31 - 1), max_size=70), st.data())
@settings(max_examples=60, deadline=None)
def test_bit_fields_round_trip(bits, values, data):
    ids = np.asarray([v % (1 << bits) for v in values], dtype=np.uint32)
    packed = token_files.pack_bits(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    first = data.draw(st.integers(0, len(ids)))
    count = data.draw(st.integers(0, len(ids) - first))
    assert (token_files.unpack_bits(packed, bits, first, count) == ids[first : first + count]).all()


@pytest.mark.parametrize("table", [hard, everything])
def test_token_file_gives_back_every_id(spark, tmp_path, table):
    docs, path = table(spark), str(tmp_path / "ids")
    token_files.write_token_file(docs, path, public_tokenizers.path(WORD), end_id=2, block_ids=500)
    rows = docs.select("doc_id", "text").collect()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, expected = 0, []
    for name, text in rows:
        ids = brute.ids_of(WORD, text) + [2]
        expected.append((name, start, len(ids), brute.crc(ids), ids))
        start += len(ids)
    got = [tuple(r) for r in token_files.read_documents(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected
    whole = [i for r in expected for i in r[4]]
    for a, n in ((0, 5), (start // 2, 700), (start - 3, 3)):
        part = token_files.read_range(spark, path, a, n).orderBy("position").collect()
        assert [r[1] for r in part] == whole[a : a + n]


def test_token_query(spark):
    got = queries.op2_token_files(spark, "/root/testdata/sf0.001").orderBy("start").collect()
    assert len(got) == everything(spark).count()
    assert [r["start"] for r in got] == list(np.cumsum([0] + [r["n_tokens"] for r in got[:-1]]))


@pytest.mark.parametrize("table", [hard, everything])
def test_pieces_fill_sequences(spark, table):
    docs = table(spark)
    got = packing.pack(docs, public_tokenizers.path(WORD), end_id=0, capacity=2048).collect()
    expected = []
    for name, text in docs.select("doc_id", "text").collect():
        ids = brute.ids_of(WORD, text) + [0]
        for piece, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            expected.append((name, piece, a, len(part), brute.crc(part)))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(expected, key=key)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(sequences) <= 1.02 * total / 2048 + 1


def best_fit_one_by_one(lengths, capacity):
    spaces = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, s in enumerate(spaces) if s >= length]
        if fits:
            spaces[min(fits, key=lambda i: spaces[i])] -= length
        else:
            spaces.append(capacity - length)
    return len(spaces)


def test_plan_equals_best_fit_of_single_pieces():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([7, 20, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        plan = packing.plan_slots({n: lengths.count(n) for n in set(lengths)}, capacity)
        used, slots = {}, 0
        for length, rank, each, sequence, offset in plan.tolist():
            later = [r for n, r, *_ in plan.tolist() if n == length and r > rank]
            count = (min(later) if later else lengths.count(length)) - rank
            for k in range(count):
                used.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
            slots += count
        assert slots == len(lengths)
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(used) == best_fit_one_by_one(lengths, capacity)


@pytest.mark.parametrize("table", [hard, everything])
def test_counts_are_the_library_s(spark, table):
    docs = table(spark)
    got = token_counts.token_counts(docs, public_tokenizers.path(BYTE), limit=512).collect()
    expected = []
    for name, text in docs.select("doc_id", "text").collect():
        n = len(brute.ids_of(BYTE, text))
        expected.append((name, len((text or "").encode()), n, n > 512))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


@given(st.text(st.characters(codec="utf-8"), max_size=80))
@settings(max_examples=300, deadline=None)
def test_counter_on_any_text(text):
    global _COUNTER
    path = public_tokenizers.path(BYTE)
    if "_COUNTER" not in globals():
        _COUNTER = token_counts.Counter(path, token_counts.prove_whole_tokens(path))
    assert _COUNTER.count(text) == len(brute.ids_of(BYTE, text))


@given(st.text(st.characters(codec="utf-8"), max_size=80))
@settings(max_examples=300, deadline=None)
def test_chunks_encode_like_whole_texts(text):
    from episcope.llm.encoders import encoder

    ids = np.frombuffer(encoder(public_tokenizers.path(WORD)).encode([text])[0], "<u4")
    assert ids.tolist() == brute.ids_of(WORD, text)


def test_proven_strings_are_most_of_the_vocabulary():
    assert len(token_counts.prove_whole_tokens(public_tokenizers.path(BYTE))) > 40_000


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    path = str(tmp_path / "none")
    token_files.write_token_file(empty, path, public_tokenizers.path(WORD), end_id=2)
    assert token_files.read_documents(spark, path).count() == 0
    assert packing.pack(empty, public_tokenizers.path(WORD)).count() == 0
    assert token_counts.token_counts(empty, public_tokenizers.path(BYTE)).count() == 0


def test_scratch_is_named(spark):
    assert os.path.isabs(scratch_folder(spark).removeprefix("file:"))
    assert zlib.crc32(b"") == 0
