"""Texts as arrays: words and stretches of words by rolling hashes, many texts at once."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap of hashes that scans look for (8 MB); a larger set is joined instead.
BITMAP_BITS = 26
#: Of a bitmap's bits, so many for each member at least.
BITS_EACH = 8
#: Bytes of text laid out as arrays at once in a task.
BYTES_AT_ONCE = 1 << 17
_rng = np.random.Generator(np.random.PCG64(20240229))
VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)     # what a byte adds to a hash
_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD6E8FEB86659FD93}     # odd, so they have inverses
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _power(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse (modulo 2 ** 64), 0 to n - 1 at least."""
    if kind not in _powers or len(_powers[kind][0]) < n:
        size = 1 << (n - 1).bit_length()
        powers = []
        for base in (_BASES[kind], pow(_BASES[kind], -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            powers.append(np.multiply.accumulate(p))
        _powers[kind] = tuple(powers)
    return _powers[kind]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def range_hash(values: np.ndarray, first: np.ndarray, end: np.ndarray, kind: str) -> np.ndarray:
    """Hash of each stretch of ``values``, the same wherever the stretch stands."""
    powers, inverse = _power(kind, len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers[:len(values)], out=total[1:])
    return mix((total[end] - total[first]) * inverse[first])


def groups(texts, at_once: int = BYTES_AT_ONCE) -> Iterator[tuple[int, list[str]]]:
    """Texts of an Arrow column, few at a time (``at_once`` characters or one text): (place of the first, texts); null is empty."""
    group, room = [], 0
    for i in range(len(texts)):
        group.append(texts[i].as_py() or "")
        room += len(group[-1])
        if room >= at_once or i + 1 == len(texts):
            yield i + 1 - len(group), group
            group, room = [], 0


class Members:
    """A set of hashes for scans to look up: a bitmap of fixed size, in which some others are, too."""

    def __init__(self, hashes: DataFrame, column: Column):
        slots = hashes.select(column.bitwiseAND(F.lit((1 << BITMAP_BITS) - 1)).alias("slot"))
        bits = (slots.selectExpr("shiftright(slot, 6) as word", "shiftleft(1L, cast(slot & 63 as int)) as bit")
                .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
        out = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.uint64)
        out[bits["word"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
        self.shared = hashes.sparkSession.sparkContext.broadcast(out.tobytes())

    def __call__(self) -> Callable[[np.ndarray], np.ndarray]:
        bits = np.frombuffer(self.shared.value, dtype=np.uint64)

        def has(h: np.ndarray) -> np.ndarray:
            slot = h & np.uint64((1 << BITMAP_BITS) - 1)
            return np.flatnonzero(bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))
        return has


def members_of(hashes: DataFrame, column: str) -> Members | None:
    """The hashes in ``column``, or None if they are too many for a bitmap to tell much."""
    return Members(hashes, F.col(column)) if hashes.count() * BITS_EACH <= 1 << BITMAP_BITS else None


def look_up(member: Members | None) -> Callable[[np.ndarray], np.ndarray]:
    """Hashes to the places of those that may be in the set."""
    return member() if member else lambda h: np.arange(len(h))
