"""Words of many texts at once, as hashes: vectorised over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: A random 64-bit value a byte; 0 is no part of a word.
VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, _MASK, 256, dtype=np.uint64, endpoint=True)
VALUES[0] = 0
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 modulo 2**64, and those of its inverse."""
    if len(_powers[0]) < n:
        size = -(-n // 65536) * 65536
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.ones(size, np.uint64)
            out[1:] = b
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads each value over all 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def table(keep) -> np.ndarray:
    """A map of bytes: upper-case ASCII to lower case, and 0 for bytes that ``keep`` refuses.
    Bytes beyond ASCII belong to letters."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b).lower()
        out[b] = b if b > 127 else ord(c) if keep(c) else 0
    return out


#: Letters and digits.
WORDS = table(str.isalnum)


#: Every byte but white space and control characters: upper-case ASCII as lower case.
SHOWN = np.array([0 if b <= 32 or b == 127 else ord(chr(b).lower()) if b < 128 else b for b in range(256)], np.uint8)
#: What byte follows what in one unit: letters and digits, or other signs.
KIND = np.array([0 if b <= 32 or b == 127 else 1 if b > 127 or chr(b).isalnum() else 2 for b in range(256)], np.int8)


def word_spans(data: np.ndarray, kind: np.ndarray | None = None, longest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, stops and hashes of the runs of bytes that aren't 0, and that are of one kind if
    kinds are given, 0 where there is no byte to be had. Runs of more than ``longest`` bytes are
    several, each of so many but the last."""
    kind = (data != 0).astype(np.int8) if kind is None else kind
    padded = np.concatenate(([0], kind, [0]))
    edge = np.flatnonzero(padded[1:] != padded[:-1])
    start, stop = edge[:-1], edge[1:]
    run = padded[start + 1] != 0
    start, stop = start[run], stop[run]
    if longest is not None and len(start) and (stop - start).max() > longest:
        parts = -(-(stop - start) // longest)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(start, parts) + nth * longest
        stop = np.minimum(start + longest, np.repeat(stop, parts))
    p, inverse = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(VALUES[data] * p[:-1], out=sums[1:])
    return start, stop, (sums[stop] - sums[start]) * inverse[start]


def chunks(texts: list[bytes], size: int = 900_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes, one text at least."""
    low = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield low, i
            low, held = i, 0
        held += len(t) + 1
    if low < len(texts):
        yield low, len(texts)


def words_of(texts: list[bytes], keep: np.ndarray, kinds: np.ndarray | None = None, longest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, stops, hashes, first word of each text and the end) of ``texts``, each a whole one."""
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    data = keep[raw]
    start, stop, hashes = word_spans(data, None if kinds is None else kinds[raw], longest)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts]))
    first = np.concatenate(([0], np.searchsorted(start, ends)))
    return data, start, stop, hashes, first


def binary(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()
