"""BLAKE3 in plain Python, from its public specification: the hash, and the keyed hash for repeatable tokens."""

from __future__ import annotations

import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tabveil.functions import values as V

#: Fixed values of the specification.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT, KEYED = 1, 2, 4, 8, 16
_MASK = 0xFFFFFFFF


def _compress(cv: tuple, block: bytes, counter: int, length: int, flags: int) -> list[int]:
    m = list(struct.unpack("<16I", block.ljust(64, b"\0")))
    v = [*cv, *IV[:4], counter & _MASK, counter >> 32, length, flags]

    def quarter(a: int, b: int, c: int, d: int, x: int, y: int) -> None:
        for word, r, s in ((x, 16, 12), (y, 8, 7)):
            v[a] = (v[a] + v[b] + word) & _MASK
            t = v[d] ^ v[a]
            v[d] = (t >> r | t << (32 - r)) & _MASK
            v[c] = (v[c] + v[d]) & _MASK
            t = v[b] ^ v[c]
            v[b] = (t >> s | t << (32 - s)) & _MASK

    for k in range(7):
        for i in range(4):
            quarter(i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            quarter(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        if k < 6:
            m = [m[p] for p in ORDER]
    return [v[i] ^ v[i + 8] for i in range(8)] + [v[i + 8] ^ cv[i] for i in range(8)]


def digest(data: bytes, key: bytes | None = None) -> bytes:
    """32 bytes; key: 32 bytes for the keyed hash."""
    start = struct.unpack("<8I", key) if key else IV
    base = KEYED if key else 0

    def chunk(part: bytes, counter: int) -> tuple:
        """The last compression of a chunk, not yet done: (cv, block, counter, length, flags)."""
        cv, blocks = start, [part[i : i + 64] for i in range(0, len(part), 64)] or [b""]
        for i, b in enumerate(blocks):
            flags = base | (CHUNK_START if i == 0 else 0) | (CHUNK_END if i == len(blocks) - 1 else 0)
            if i == len(blocks) - 1:
                return cv, b, counter, len(b), flags
            cv = tuple(_compress(cv, b, counter, 64, flags)[:8])
        raise AssertionError

    def tree(chunks: list[bytes], first: int) -> tuple:
        if len(chunks) == 1:
            return chunk(chunks[0], first)
        half = 1 << ((len(chunks) - 1).bit_length() - 1)
        sides = [_compress(*tree(c, f))[:8] for c, f in ((chunks[:half], first), (chunks[half:], first + half))]
        return start, struct.pack("<16I", *sides[0], *sides[1]), 0, 64, base | PARENT

    cv, block, counter, length, flags = tree([data[i : i + 1024] for i in range(0, len(data), 1024)] or [b""], 0)
    return struct.pack("<16I", *_compress(cv, block, counter, length, flags | ROOT))[:32]


def token_udf(key_hex: str, header: str, index: int, label: str = "keyed-token/v1") -> Callable[[Column], Column]:
    """tok_ and 24 digits of the keyed hash of label, NUL, column place (8 bytes, little-endian), header, NUL and identity key.

    The key lives in the function's closure and so is in no plan that `explain` prints.
    """
    if len(key_hex) != 64:
        raise ValueError("a key has 64 hexadecimal digits")
    key, prefix = bytes.fromhex(key_hex), label.encode() + b"\0" + struct.pack("<Q", index) + header.encode() + b"\0"

    @F.pandas_udf(StringType())
    def token(keys: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return keys.map(lambda k: None if k is None else known.get(k) or known.setdefault(k, "tok_" + digest(prefix + k.encode(), key).hex()[:24]))

    return lambda v: token(V.identity_key(v))
