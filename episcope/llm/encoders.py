"""Public tokenizer files inside tasks: cached encoding of white-space chunks.

A tokenizer whose pre-tokens never hold white space encodes the chunks between blanks on their own,
so a chunk seen before costs one dictionary lookup. Files whose rules are known (composition, blanks,
lower case, a cutting pattern, byte-level BPE) are recognised by their specification; for others whole
texts are encoded.
"""

from __future__ import annotations

import json
import os
import sys
from array import array
from functools import lru_cache

import numpy as np
import regex

#: Chunks and pre-tokens kept per worker, and the longest that are kept. Past the bound they start anew.
CACHE_ENTRIES, CACHE_CHARS = 1_000_000, 40
#: Signs that often end a chunk and never start a longer pre-token there.
END_SIGNS = frozenset(".,;:!?")


def _cuts_at_white_space(spec: dict) -> bool:
    """True if the file says that pre-tokens are found by a pattern that leaves white space out."""
    pre = spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    first = steps[0] if steps else {}
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
        return False
    if first["pattern"].get("Regex") is None or len(steps) < 2:
        return False
    if any(s.get("type") != "ByteLevel" or s.get("add_prefix_space") or s.get("use_regex") for s in steps[1:]):
        return False
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or steps[1]["pattern"] != {"Regex": r"\s+"}:
        return False
    if spec["model"]["type"] != "BPE" or any(t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        return False
    pattern = regex.compile(first["pattern"]["Regex"])
    return not any(pattern.search(blank) for blank in " \n\t\r")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Chunks(dict):
    """Ids of chunks between blanks, and of the pre-tokens in them.

    A printable chunk of Latin-1 characters without special tokens has nothing to compose, one lower case and no
    doubtful class, so it is cut here, and only pre-tokens not seen before are merged by the library's
    model. Other chunks go to the library whole.
    """

    def __init__(self, tokenizer, pattern: str):
        super().__init__()
        self.tokenizer, self.model, self.cut = tokenizer, tokenizer.model, regex.compile(pattern).findall
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        special = [regex.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(special) or "(?!)").search

    def _merged(self, token: str) -> bytes:
        letters = token if token.isascii() else token.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _ids(self, chunk: str) -> bytes:
        if not chunk.isascii() and max(chunk) > "\u00ff":
            return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        if chunk.isalpha():
            lower = chunk.lower()
            return self._merged(chunk) if lower == chunk else self[lower]
        if chunk[-1:] in END_SIGNS and chunk[:-1].isalpha():
            return self[chunk[:-1]] + self[chunk[-1]]
        if not chunk.isprintable() or self.special(chunk):
            return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        parts = self.cut(chunk.lower())
        return self._merged(chunk) if parts == [chunk] else b"".join(map(self.__getitem__, parts))

    def __missing__(self, chunk: str) -> bytes:
        ids = self._ids(chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, as the library gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.chunks = None
        if _cuts_at_white_space(spec) and sys.byteorder == "little" and array("I").itemsize == 4:
            pre = spec["pre_tokenizer"]
            self.chunks = _Chunks(self.tokenizer, pre.get("pretokenizers", [pre])[0]["pattern"]["Regex"])

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.chunks is None:
            encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [np.asarray(e.ids, dtype="<u4").tobytes() for e in encoded]
        ids = self.chunks.__getitem__
        blanks = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        return [b"".join(map(ids, chunks)) for chunks in blanks]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)


def vocabulary_size(path: str) -> int:
    """Ids are below this number, added tokens included."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
