"""numpy kernels over joined texts: words, polynomial hashes of slices, sliding minima."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Letters, digits and all bytes of longer code points: what words of the text classifier are made of.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """1, base, base**2 ... modulo 2**64."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        have = _tables[base] = np.cumprod(p, dtype=np.uint64)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads differences over all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums from which slice_hash takes any slice's hash; symbols: bytes or uint64."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    s = symbols.astype(np.uint64) + np.uint64(1)
    s *= powers(len(symbols))
    np.cumsum(s, out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices [start, end); equal slices have equal hashes wherever they stand."""
    h = prefix[end] - prefix[start]
    h *= powers(len(prefix), _INVERSE)[start]
    h ^= (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix64(h)


def word_bounds(buf: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that the table `inside` marks."""
    flags = np.zeros(len(buf) + 2, np.int8)
    flags[1:-1] = inside[buf]
    edges = np.diff(flags)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


_LANES = 4
_LANE_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(data: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the words data[a:b]. Words go in as lanes of 8 bytes, each mixed before the next; those of more than four lanes by BLAKE2b.

    No polynomial: long words can't be made to collide as they can modulo 2**64.
    """
    lanes = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))  # the 8 bytes from each place on
    size = b - a
    h = mix64((lanes[a] & _LANE_MASKS[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    some = np.arange(len(a))
    for lane in range(1, _LANES):
        some = some[size[some] > 8 * lane]
        if not len(some):
            break
        own = lanes[a[some] + 8 * lane] & _LANE_MASKS[np.minimum(size[some] - 8 * lane, 8)]
        h[some] = mix64(h[some] * np.uint64(_BASE) + own)
    for i in np.flatnonzero(size > 8 * _LANES).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[a[i] : b[i]], digest_size=8).digest(), "little")
    return h


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values, sorted."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def repeats(h: np.ndarray) -> np.ndarray:
    """The places of the values that occur more than once, sorted by value."""
    order = np.argsort(h)
    same = np.diff(h[order]) == 0
    many = np.zeros(len(h), bool)
    many[1:] |= same
    many[:-1] |= same
    return order[many]


def count_words(data: bytes, chunk: int = 1 << 20) -> int:
    """Runs of other than the six white-space bytes."""
    n, space = 0, True
    for at in range(0, len(data), chunk):
        gaps = SPACES[np.frombuffer(data, np.uint8, min(chunk, len(data) - at), at)]
        n += int(np.count_nonzero(gaps[:-1] & ~gaps[1:])) + (space and not gaps[0])
        space = bool(gaps[-1])
    return n


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of each `width` consecutive values, by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: n], out[rest : rest + n]) if rest else out[:n]


def grouped(items: Iterable[tuple[object, bytes]], most: int) -> Iterator[tuple[list, list[bytes]]]:
    """Keys and byte strings in groups of about `most` bytes; a longer string is a group of its own."""
    keys, parts, size = [], [], 0
    for key, data in items:
        if parts and size + len(data) > most:
            yield keys, parts
            keys, parts, size = [], [], 0
        keys.append(key)
        parts.append(data)
        size += len(data)
    if parts:
        yield keys, parts


def joined(parts: list[bytes], gap: bytes = b"\n") -> tuple[np.ndarray, bytes, np.ndarray]:
    """All parts in one buffer, a gap byte between two; the buffer as array and bytes, and where each part starts."""
    data = gap.join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.concatenate(([0], np.cumsum(sizes + len(gap))[:-1])) if len(parts) else np.zeros(0, np.int64)
    return np.frombuffer(data, np.uint8), data, starts
