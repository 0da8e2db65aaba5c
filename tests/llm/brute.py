"""Plain single-process versions that the Spark operators are held against."""

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer


@lru_cache(maxsize=4)
def tokenizer(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def ids_of(name, text):
    return tokenizer(name).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii_base(text):
    spans = []
    for rank, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                spans.append((m.start(), rank, kind, m.end()))
    return sorted(spans)


def pii_row(text):
    spans = pii_base(text)
    base = ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)
    return [sum(x[2] == k for x in spans) for k in PII] + [hashlib.sha256(base.encode()).hexdigest()]
