"""Token counts with the whole-token shortcut.

A byte-level BPE file splits texts into pre-tokens and merges each on its own. Offline, every
vocabulary string is encoded alone; those that give one token and are one pre-token are proven. A text
is then cut into pre-tokens, each proven one counts 1 by lookup, and only the rest is merged by the
library (and remembered, up to a bound).

The cutting pattern runs in Python, whose character classes can be of another Unicode version than the
library's. Each non-ASCII character is therefore tried once per worker against the library's own cutter;
a text with a character on which they differ is encoded whole by the library.

Defined results: a null or empty text has no bytes and no tokens; rows stay rows, ids are not compared;
an empty table gives no rows. Texts of any length are read piece by piece.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episcope.llm.common import id_and_text

#: The pre-token pattern of byte-level BPE files (fixed value).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Merged pre-tokens kept per worker; past the bound they are dropped and merged again when seen.
MERGED_ENTRIES = 200_000


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _is_byte_level(spec: dict) -> bool:
    pre = spec.get("pre_tokenizer") or {}
    plain = not spec.get("normalizer") and not any(
        t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])
    )
    return plain and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True)


def prove_whole_tokens(path: str) -> list[str]:
    """Vocabulary strings that are one pre-token and that the library encodes alone as one token."""
    tokenizer, pattern = _tokenizer(path), regex.compile(BYTE_LEVEL_PATTERN)
    with open(path, encoding="utf-8") as f:
        if not _is_byte_level(json.load(f)):
            return []
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    strings = [tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())]
    strings = [s for s in dict.fromkeys(strings) if s and "�" not in s and s not in added]
    strings = [s for s in strings if pattern.findall(s) == [s]]
    encoded = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
    return [s for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1]


class _Costs(dict):
    """Tokens per pre-token: proven ones are there, others are merged by the library when first seen."""

    def __init__(self, whole: list[str], tokenizer):
        super().__init__(dict.fromkeys(whole, 1))
        self.bound, self.whole, self.tokenizer = len(whole) + MERGED_ENTRIES, whole, tokenizer

    def __missing__(self, token: str) -> int:
        cost = len(self.tokenizer.encode(token, add_special_tokens=False).ids)
        if len(token) <= 64:
            if len(self) >= self.bound:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[token] = cost
        return cost


class Counter:
    def __init__(self, path: str, whole: list[str]):
        self.tokenizer, self.pattern = _tokenizer(path), regex.compile(BYTE_LEVEL_PATTERN)
        self.costs, self.usable = _Costs(whole, self.tokenizer), bool(whole)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.same = set(map(chr, range(128)))
        self.other: set[str] = set()

    def _agrees(self, char: str) -> bool:
        for probe in (f"a{char}b", f"1{char}2", f"!{char}!", f" {char} {char}{char} a"):
            cut, at = [], 0
            for token in self.pattern.findall(probe):
                cut.append((at, at + len(token)))
                at += len(token)
            if cut != [p for _, p in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]:
                return False
        return True

    def _known(self, text: str) -> bool:
        if text.isascii():
            return True
        for char in set(text) - self.same:
            if char in self.other or not self._agrees(char):
                self.other.add(char)
                return False
            self.same.add(char)
        return True

    def _between(self, text: str) -> int:
        if len(text) < 1_000_000:
            return sum(map(self.costs.__getitem__, self.pattern.findall(text)))
        return sum(self.costs[m[0]] for m in self.pattern.finditer(text))

    def count(self, text: str) -> int:
        if not self.usable or not self._known(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.special is None or not self.special.search(text):
            return self._between(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._between, parts))


@lru_cache(maxsize=2)
def _counter(path: str, whole: tuple[str, ...]) -> Counter:
    return Counter(path, list(whole))


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for every row.

    The proven strings are at most one per vocabulary entry, and go to the workers as a broadcast value.
    """
    whole = docs.sparkSession.sparkContext.broadcast(tuple(prove_whole_tokens(tokenizer)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or _counter(tokenizer, whole.value)
            texts = batch.column("text")
            n = [counter.count(texts[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_tokens": pa.array(n, pa.int64())}
            )

    rows = id_and_text(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
