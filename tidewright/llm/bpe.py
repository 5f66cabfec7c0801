"""Byte-level BPE: texts to packed token ids and back."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the split pattern's ``\s`` sees it (fixed values: Unicode's White_Space property).
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(f"[{_SPACES}]{{512,}}")
_SAFE_CUT = re.compile(r"[A-Za-z0-9](?= )")
#: Texts are given to the library in parts of about this many characters.
PART = 1 << 16


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _parts(text: str, size: int) -> Iterator[str]:
    """The text, cut where a letter or digit meets a space: no match of the pattern crosses from a character that
    isn't white space to one that is, and what is matched on either side doesn't depend on the other."""
    start = 0
    while len(text) - start > size and (m := _SAFE_CUT.search(text, start + size)):
        yield text[start:m.end()]
        start = m.end()
    yield text[start:]


def _pack(encoding, text: str, size: int = PART) -> bytes:
    """Ids as little-endian 32-bit integers. A long run of white space is one match, but for its last character if
    something follows; it goes to the merging step directly, as the library's regular expressions overflow on it."""
    out, start = [], 0
    for m in _LONG_RUN.finditer(text):
        out += [encoding.encode_to_numpy(p, disallowed_special=()) for p in _parts(text[start:m.start()], size)]
        start = m.end() - (m.end() < len(text))
        out.append(np.array(encoding._encode_single_piece(text[m.start():start]), dtype="<u4"))
    out += [encoding.encode_to_numpy(p, disallowed_special=()) for p in _parts(text[start:], size)]
    return np.concatenate(out).astype("<u4").tobytes()


def _unpack(encoding, ids: bytes, size: int = PART) -> bytes:
    numbers = np.frombuffer(ids, dtype="<u4")
    return b"".join(encoding.decode_bytes(numbers[i:i + size].tolist()) for i in range(0, len(numbers), size))


def encode(text: Column, path: str, pattern: str) -> Column:
    """Token ids of whole texts, packed as little-endian unsigned 32-bit integers (binary), the form training shards
    use. ``path``: a rank file, at the same place on every executor; ``pattern``: the split pattern, one that ends in
    ``\\s+(?!\\S)|\\s+`` and has no match that goes on from other characters into white space. Special tokens are
    ordinary text. Null and empty texts give no ids. Repeated rows give equal ids; other columns don't matter."""

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        e = _encoding(path, pattern)
        return texts.map(lambda t: _pack(e, t) if t else b"")

    return packed(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The bytes behind packed ids, joined before anything reads them as characters, so that a character split over
    several tokens comes back whole. Null gives no bytes; an id without a rank fails."""

    @F.pandas_udf("binary")
    def raw(packed: pd.Series) -> pd.Series:
        e = _encoding(path, pattern)
        return packed.map(lambda b: _unpack(e, b) if b else b"")

    return raw(ids)


def token_count(ids: Column) -> Column:
    return F.floor(F.octet_length(ids) / 4).cast("long")
