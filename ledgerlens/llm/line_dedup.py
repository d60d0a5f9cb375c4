"""Fuzzy line deduplication.

Lines are normalised (lower-case words; in scripts without blanks, characters) and
hashed; equal lines are one node, represented by their first occurrence. A pair of
nodes is linked when its word edit similarity is 0.8 or more, and each connected
group keeps one occurrence, its first.

Candidates come from SimHash blocks. The words of a line fall into a few groups by
their hash, and each group gives one block of the line's fingerprint: the SimHash (64
bits, by vote) of its different words, each of which votes once, so that common words
do not decide it. An edit touches the blocks of the words it takes and puts, and no
other, so while the edits touch fewer blocks than there are, one block is the same in
both lines: lines meet by an equality join on (size class, block).
``GROUPS`` holds how many blocks a class has; that they are fewer than the most edits
could touch, and that blocks of less than ``LEAST_WORDS`` words are no key, costs some of
the pairs with very many edits (recall in the README). Of two lines that meet, sizes
and SimHashes of the whole lines (``MAX_BITS``) are compared before their words are.

Under a key that few lines share all pairs are held against each other; in a larger one
first every line against its centre, the line nearest to the bits that most of them
have. Then only pairs that these links have not connected are looked at; where
they still are too many, under keys of two parts: the key and one of the line's
longest other words, so many of them that no pair is lost.

Only hashes and positions are shuffled. The words of a line travel only for the
lines of candidate pairs. Scans find what they look for by bitmaps of fixed size, or
by a join where these would be too full.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .arrays import VALUE, groups, look_up, members_of, mix, range_hash
from .common import SPACED, cut, renamed, small_batches, stored
from .components import connected_components, joined_components

MIN_WORDS = 1        # lines without a word are never repeats
MIN_SIMILARITY = 0.8
#: Words of the longer line of the shortest near pair; each size class goes from there to twice as many.
SHORTEST = 5
#: Blocks of the fingerprint of lines of 5, 10, 20, 40, 80 words and more, and for how many ways of dealing words to them.
GROUPS, WAYS = (3, 4, 5, 6, 8), (2, 2, 1, 1, 1)
#: Different words of a block that is a key, by class.
LEAST_WORDS = (1, 2, 2, 3, 3)
#: Bits in which the SimHashes of two lines may differ (at similarity 0.8 they differ in 13, with a deviation of 3).
MAX_BITS = 24
#: Words above which the votes of a stretch are counted by themselves.
MANY = 256
#: Lines under one key that are held against each other, all pairs; pairs under a larger one that may be left to look at.
FEW, OPEN_PAIRS = 12, 4_000_000
#: Characters of scripts without blanks (Thai, Lao, Burmese, Khmer, kana, Han) are words each.
_APART = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: First bytes of characters of three bytes and more, as all of these are.
_LONG_LEADS = bytes(range(0xe0, 0xf8))
_KIND = bytes(2 if chr(c).isalnum() or c >= 128 else 1 if c == 10 else 0 for c in range(256))
#: Characters of text laid out as arrays at once.
CHARS_AT_ONCE = 1 << 18
#: Keys that a task brings into order at once, and lines for each part of the table of keys (up to 15 keys each).
KEYS_AT_ONCE, LINES_A_PART = 1 << 19, 50_000
_LINES = bytes(10 if c == 10 else SPACED[c] for c in range(256))


def _lower_bytes(text: str) -> bytes:
    """Lower-case UTF-8 of a text, with blanks around each character that is a word."""
    text = text.lower()
    data = text.encode("utf-8", "replace")
    if data.isascii() or len(data.translate(None, _LONG_LEADS)) == len(data):
        return data
    return _APART.sub(r" \g<0> ", text).encode("utf-8", "replace")


def majority(words: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """SimHash of each stretch ``words[first:first + count]``: the bits set in over half of its hashes.

    Stretches of up to 1, 2, 4 ... words (but those of over ``MANY``) are columns of one matrix, filled up with zeros, and
    their votes are added in pairs of rows, bit by bit of the counts: plane j holds bit j of the 64 counts of each number."""
    out = np.zeros(len(count), dtype=np.uint64)
    for i in np.flatnonzero(count > MANY).tolist():
        votes = np.zeros(64, dtype=np.int64)
        for at in range(int(first[i]), int(first[i] + count[i]), 1 << 14):
            part = words[at:min(at + (1 << 14), int(first[i] + count[i]))]
            votes += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * votes > count[i], bitorder="little").view("<u8")[0]
    for k in range(MANY.bit_length()):
        own = np.flatnonzero((count <= min(1 << k, MANY)) & (count > 1 << k >> 1))
        if not len(own):
            continue
        row = np.arange(1 << k)[:, None]
        planes = [words.take(first[own] + row, mode="clip")]
        planes[0][1 << k >> 1:] *= row[1 << k >> 1:] < count[own]
        while len(planes[0]) > 1:
            half, carry, added = len(planes[0]) // 2, None, []
            for plane in planes:
                a, b = plane[:half], plane[half:]
                odd, both = a ^ b, a & b
                added.append(odd if carry is None else odd ^ carry)
                carry = both if carry is None else both | odd & carry
            planes = added + [carry]
        over, equal = np.zeros(len(own), dtype=np.uint64), np.full(len(own), ~np.uint64(0))
        need = count[own] // 2
        for j in reversed(range(len(planes))):
            bit = np.where(need >> j & 1, ~np.uint64(0), np.uint64(0))
            over |= equal & planes[j][0] & ~bit
            equal &= ~(planes[j][0] ^ bit)
        out[own] = over
    return out


class Lines:
    """The lines of some texts as arrays: ``doc`` and ``line`` number, ``size`` (words), ``h`` (hash of the words)."""

    def __init__(self, texts: list[str]):
        data = b"".join(_lower_bytes(t) + b"\n" for t in texts)
        kind = np.frombuffer(data.translate(_KIND), dtype=np.uint8)
        within = kind == 2
        edge = np.flatnonzero(within[1:] != within[:-1]) + 1      # begin and end of each word; a break is last
        if within[:1].any():
            edge = np.concatenate(([0], edge))
        self.first, self.end = edge[::2].copy(), edge[1::2].copy()
        self.word = range_hash(VALUE[np.frombuffer(data, dtype=np.uint8)], self.first, self.end, "byte")
        breaks = np.flatnonzero(kind == 1)
        upto = np.searchsorted(self.first, breaks)
        self.start = np.concatenate(([0], upto[:-1])) if len(upto) else upto     # first word of each line
        self.size = upto - self.start
        self.h = range_hash(self.word, self.start, upto, "word")
        counts = np.array([t.count("\n") + 1 for t in texts], dtype=np.int64)
        self.doc = np.repeat(np.arange(len(texts)), counts)
        self.line = np.arange(len(self.doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.data, self.breaks = data, breaks

    def words_of(self, i: int) -> bytes:
        """Normalised words of line ``i``."""
        begin = int(self.breaks[i - 1]) + 1 if i else 0
        return b" ".join(self.data[begin:int(self.breaks[i])].translate(SPACED).split())

    def different(self) -> np.ndarray:
        """One line of each kind that is long enough to have a near one."""
        long = np.flatnonzero(self.size + 1e-9 >= SHORTEST * MIN_SIMILARITY)
        return long[np.unique(self.h[long], return_index=True)[1]]

    def _different(self, number: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words (by number) that stand in slots, by slot, each word of a slot once; and their slots."""
        key = slot.astype(np.uint64) << np.uint64(40) | self.word[number] >> np.uint64(24)
        order = np.argsort(key)
        key = key[order]
        order = order[np.concatenate(([True], key[1:] != key[:-1]))] if len(order) else order
        return number[order], slot[order]

    def simhash(self, lines: np.ndarray) -> np.ndarray:
        """SimHash of the different words of each of the given lines."""
        size = self.size[lines]
        first = np.cumsum(size) - size
        number, slot = self._different(np.repeat(self.start[lines] - first, size) + np.arange(size.sum()), np.repeat(np.arange(len(lines)), size))
        count = np.bincount(slot, minlength=len(lines))
        return majority(self.word[number], np.cumsum(count) - count, count)

    def odd(self, lines: np.ndarray) -> np.ndarray:
        """64 bits of each of the given lines (with words), each set by an odd number of its words: an edit changes two at most."""
        if not len(lines):
            return np.zeros(0, dtype=np.uint64)
        size = self.size[lines]
        first = np.cumsum(size) - size
        words = self.word[np.repeat(self.start[lines] - first, size) + np.arange(size.sum())]
        return np.bitwise_xor.reduceat(np.uint64(1) << (words >> np.uint64(58)), first)

    def entries(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``lines``, size class, way of dealing) of everything the lines are cut into blocks for:
        their own class, and the next one where a longer near line may be in it."""
        size = self.size[lines]
        own = np.floor(np.log2(size / SHORTEST) + 1e-12).astype(np.int64)
        longer = np.flatnonzero((size / MIN_SIMILARITY + 1e-9).astype(np.int64) >= SHORTEST << (own + 1))
        itself = np.flatnonzero(size >= SHORTEST)
        at, kind = np.concatenate((itself, longer)), np.concatenate((own[itself], own[longer] + 1))
        ways = np.array(WAYS)[np.minimum(kind, len(WAYS) - 1)]
        return np.repeat(at, ways), np.repeat(kind, ways), np.arange(ways.sum()) - np.repeat(np.cumsum(ways) - ways, ways)

    def blocks(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the given lines (such as ``different`` gives) and the place in ``lines`` of each; then the words
        of all keyed blocks (numbers of different words, one block after the other), where each block begins among them and how many it has."""
        at, kind, way = self.entries(lines)
        size = self.size[lines[at]]
        first = np.cumsum(size) - size
        number = np.repeat(self.start[lines[at]] - first, size) + np.arange(size.sum())
        n_groups = np.array(GROUPS)[np.minimum(kind, len(GROUPS) - 1)]
        salt = mix((kind * 8 + way + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        entry = np.repeat(np.arange(len(at)), size)
        group = (mix(self.word[number] ^ salt[entry]) >> np.uint64(33)).astype(np.int64) % n_groups[entry]
        number, slot = self._different(number, entry * max(GROUPS) + group)
        begin = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))) if len(slot) else np.zeros(0, dtype=np.int64)
        count = np.diff(np.append(begin, len(slot)))
        owner = slot[begin] // max(GROUPS)
        enough = count >= np.array(LEAST_WORDS)[np.minimum(kind[owner], len(LEAST_WORDS) - 1)]
        begin, count, owner, label = begin[enough], count[enough], owner[enough], slot[begin][enough] % max(GROUPS)
        block = majority(self.word[number], begin, count)
        key = mix(block ^ mix(salt[owner] + label.astype(np.uint64)))
        return key, at[owner], number, begin, count


def most_edits(longest, least: float = MIN_SIMILARITY):
    """Edits that a pair may have whose longer line has ``longest`` words (a number or an array)."""
    return np.asarray((1 - least) * longest + 1e-9).astype(np.int64)


def _batches(emit: Callable[[Lines], dict], names: list[str], take: list[str]):
    """Arrow batches of documents (``text`` and more) to rows that ``emit`` makes of their lines; with the columns
    ``take`` of the document ``doc`` that a row is of."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, texts in groups(batch.column("text"), CHARS_AT_ONCE):
                rows = emit(Lines(texts))
                of = [batch.column(c).take(pa.array(base + rows["doc"], pa.int64())) for c in take]
                yield pa.RecordBatch.from_arrays(of + [pa.array(rows[n]) if isinstance(rows[n], np.ndarray) else rows[n] for n in names], names=take + names)
    return run


def lines_of(docs: DataFrame) -> DataFrame:
    """``id``, ``th``, ``text`` to one row per line with words (a written table): ``id``, ``th``, ``line`` (from 0), its hash ``h``,
    ``size`` (words), ``sim`` (SimHash of the line), ``odd`` and the ``keys`` of its blocks (8 bytes each). Of equal lines that
    a task sees together only one has keys."""
    def emit(t: Lines) -> dict:
        some = np.flatnonzero(t.size >= MIN_WORDS)
        lines = t.different()
        key, at, *_ = t.blocks(lines)
        order = np.argsort(at, kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(lines))), [len(at)]))      # and one line without keys
        keys = _runs(key[order], ends)
        place = np.full(len(t.size), len(lines))
        place[lines] = np.arange(len(lines))
        place = place[some]
        held = {"sim": np.append(t.simhash(lines), np.uint64(0)), "odd": np.append(t.odd(lines), np.uint64(0))}
        return {"doc": t.doc[some], "line": t.line[some].astype(np.int32), "h": t.h[some].view(np.int64), "size": t.size[some].astype(np.int32),
                "keys": keys.take(pa.array(place))} | {n: v.view(np.int64)[place] for n, v in held.items()}
    names = ["line", "h", "size", "sim", "odd", "keys"]
    id_type = docs.schema["id"].dataType.simpleString()
    return stored(docs.select("id", "th", "text").mapInArrow(
        _batches(emit, names, ["id", "th"]), f"id {id_type}, th long, line int, h long, size int, sim long, odd long, keys binary"), "lines")


def _runs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary column of the rows of ``values`` (8 bytes a number) from each of ``ends`` to the next."""
    offsets = (ends * (values.strides[0])).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a binary column, row after row, and how many each row has."""
    return (np.frombuffer(b"".join(column.to_pylist()), dtype=np.int64),
            pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 8)


def _extremes(key: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order (as unsigned numbers), and the smallest and largest ``h`` of each."""
    order = np.argsort(key.view(np.uint64))
    key, h = key[order], h[order]
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    if not len(begin):
        return key, h, h
    return key[begin], np.minimum.reduceat(h, begin), np.maximum.reduceat(h, begin)


def shared_keys(lines: DataFrame) -> DataFrame:
    """``key``: those of two different lines or more. Keys and lines are shuffled in runs of numbers, one for each part of
    the table, of which a task sends two lines at most under one key."""
    # several parts for each shuffle partition, so that they spread evenly
    parts = max(4 * shuffle_partitions(lines.sparkSession), lines.count() // LINES_A_PART + 1)

    def run_of(key: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        key, low, high = _extremes(key, h)
        sent = 1 + (low != high)
        rows = np.stack((np.repeat(key, sent), np.repeat(low, sent)), axis=1)
        rows[np.cumsum(sent) - 1, 1] = high
        part = ((rows[:, 0].view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        return pa.RecordBatch.from_arrays([pa.array(part[begin].astype(np.int32)), _runs(rows, np.append(begin, len(rows)))], names=["part", "run"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, hs, room = [], [], 0
        for batch in batches:
            key, count = _numbers(batch.column("keys"))
            keys.append(key)
            hs.append(np.repeat(batch.column("h").to_numpy(zero_copy_only=False), count))
            room += len(key)
            if room >= KEYS_AT_ONCE:
                yield run_of(np.concatenate(keys), np.concatenate(hs))
                keys, hs, room = [], [], 0
        if room:
            yield run_of(np.concatenate(keys), np.concatenate(hs))

    def shared(part: pa.Table) -> pa.Table:
        rows = _numbers(part.column("run").combine_chunks())[0].reshape(-1, 2)
        key, low, high = _extremes(np.ascontiguousarray(rows[:, 0]), rows[:, 1])
        return pa.table({"key": key[low != high]})

    runs = lines.select("h", "keys").mapInArrow(deal, "part int, run binary")
    return cut(runs.groupBy("part").applyInArrow(shared, "key long"))


#: What is known of a line under a key.
MEMBER = {"h": "long", "size": "int", "sim": "long", "odd": "long"}
_MEMBER = "key long, " + ", ".join(f"{n} {t}" for n, t in MEMBER.items())


def members_under(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """Lines under each of ``keys`` (and perhaps others): ``key`` and the columns ``MEMBER``."""
    member = members_of(keys, "key")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = look_up(member)
        for batch in batches:
            key, count = _numbers(batch.column("keys"))
            line = np.repeat(np.arange(len(batch)), count)
            hit = has(key.view(np.uint64))
            at = pa.array(line[hit])
            yield pa.RecordBatch.from_arrays([pa.array(key[hit]), *[batch.column(c).take(at) for c in MEMBER]], names=["key", *MEMBER])

    rows = lines.select(*MEMBER, "keys").mapInArrow(pick, _MEMBER)
    return cut(rows.distinct() if member else rows.join(keys, "key", "left_semi").distinct())


def members_split(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Lines under ``keys`` that too many share, under keys of two parts: the old one and a word of the line that is
    not of that block. Two near lines of k edits differ in k of these at most on either side, so one of the
    first k + 1 in any order is the same; the order is by length, as long words are seldom common."""
    member = members_of(keys, "key")

    def emit(t: Lines) -> dict:
        lines = t.different()
        key, at, number, begin, count = t.blocks(lines)
        out = {n: [] for n in ("base", "key", *MEMBER)}
        for b in look_up(member)(key).tolist():
            i = int(lines[at[b]])
            every = np.arange(t.start[i], t.start[i] + t.size[i])
            rest = every[~np.isin(t.word[every], t.word[number[begin[b]:begin[b] + count[b]]])]
            n = int(most_edits(int(t.size[i] / MIN_SIMILARITY + 1e-9))) + 1
            chosen = rest[np.lexsort((t.word[rest], t.first[rest] - t.end[rest]))[:n]]
            # a line that is the block and a few words more may share the block alone
            sub = np.append(mix(key[b] ^ mix(t.word[chosen])), key[b:b + 1]) if len(rest) < n else mix(key[b] ^ mix(t.word[chosen]))
            out["key"].append(sub)
            for name, value in (("base", key[b]), ("h", t.h[i]), ("size", t.size[i]), ("sim", t.simhash(np.array([i]))[0]), ("odd", t.odd(np.array([i]))[0])):
                out[name].append(np.full(len(sub), value))
        none = np.zeros(0, dtype=np.uint64)
        rows = {n: np.concatenate(v) if v else none for n, v in out.items()}
        return {n: v.astype(np.int32) if n == "size" else v.view(np.int64) for n, v in rows.items()}

    rows = docs.select("text").mapInArrow(_batches(emit, ["base", "key", *MEMBER], []), "base long, " + _MEMBER)
    if member is None:
        rows = rows.join(keys.withColumnRenamed("key", "base"), "base", "left_semi")
    return cut(rows.select("key", *MEMBER).distinct())


def _near(a: str, b: str):
    """Whether lines can be near by size, by their words in odd numbers, and by SimHash; of columns with these endings."""
    size, other = F.col(f"size{a}"), F.col(f"size{b}")
    edits = F.floor(F.greatest(size, other) * F.lit(1 - MIN_SIMILARITY) + F.lit(1e-9))
    bits = {n: F.bit_count(F.col(f"{n}{a}").bitwiseXOR(F.col(f"{n}{b}"))) for n in ("odd", "sim")}
    return (F.abs(size - other) <= edits) & (bits["odd"] <= 2 * edits) & (bits["sim"] <= MAX_BITS)


def _pairs(members: DataFrame, apart: str = "h") -> DataFrame:
    """Pairs ``u``, ``v`` of possibly near lines under one key whose ``apart`` differ."""
    b = members.withColumnsRenamed({c: f"{c}_b" for c in members.columns})
    return members.join(b, (F.col("key") == F.col("key_b")) & (F.col(apart) < F.col(f"{apart}_b")) & _near("", "_b")).select(
        F.col("h").alias("u"), F.col("h_b").alias("v"))


def words_of_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``h``, ``words`` (normalised) of the lines whose hash is in ``wanted`` (``h``, distinct)."""
    member = members_of(wanted, "h")

    def emit(t: Lines) -> dict:
        lines = t.different()
        lines = lines[look_up(member)(t.h[lines])]
        return {"h": t.h[lines].view(np.int64), "words": pa.array([t.words_of(int(i)) for i in lines], pa.binary())}
    found = docs.select("text").mapInArrow(_batches(emit, ["h", "words"], []), "h long, words binary")
    return found.join(wanted, "h", "left_semi").groupBy("h").agg(F.min("words").alias("words"))


def verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``u``, ``v``) whose lines have the edit similarity (a written checkpoint). ``words``: of all their lines."""
    left = words.select(F.col("h").alias("u"), F.col("words").alias("words_u"))
    right = words.select(F.col("h").alias("v"), F.col("words").alias("words_v"))

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y) >= MIN_SIMILARITY for x, y in zip(a, b)], dtype=bool)

    return cut(pairs.join(left, "u").join(right, "v").filter(alike("words_u", "words_v")).select("u", "v"))


def similarity(a: bytes, b: bytes, least: float = MIN_SIMILARITY) -> float:
    """1 - word edit distance / words of the longer line; 0 where that is below ``least``.

    For each number of edits the furthest place reached on each diagonal: the
    work grows with the lines' length and the square of their distance."""
    x, y = a.split(), b.split()
    longest = max(len(x), len(y))
    if longest == 0:
        return 1.0
    limit = int((1 - least) * longest + 1e-9)
    if abs(len(x) - len(y)) > limit:
        return 0.0
    begin = _along(x, y, 0, 0)      # what both begin and end with is no part of the distance
    end = _along(x[:begin - 1 if begin else None:-1], y[:begin - 1 if begin else None:-1], 0, 0)
    x, y = x[begin:len(x) - end], y[begin:len(y) - end]
    n, m = len(x), len(y)
    if len(set(y).difference(x)) > limit - max(0, n - m) or len(set(x).difference(y)) > limit - max(0, m - n):
        return 0.0      # so many words have no partner at all
    if limit > MANY and max(n, m) - sum((Counter(x) & Counter(y)).values()) > limit:
        return 0.0
    reach = {0: _along(x, y, 0, 0)}
    edits = 0
    while reach.get(m - n, -1) < n:
        edits += 1
        if edits > limit:
            return 0.0
        further = {}
        for k in range(max(-edits, -n), min(edits, m) + 1):       # diagonal: place in y - place in x
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2), reach.get(k + 1, -2) + 1)
            i = min(i, n, m - k)
            if i >= 0 and i + k >= 0:
                further[k] = _along(x, y, i, i + k)
        reach = further
    return 1 - edits / longest


def _along(x: list[bytes], y: list[bytes], i: int, j: int) -> int:
    """Where in ``x`` the equal words from ``x[i]``, ``y[j]`` on end."""
    end = min(len(x), len(y) + i - j)
    while i < end and x[i] == y[j]:
        i += 1
        j += 1
    return i

def centres(members: DataFrame) -> DataFrame:
    """``key``, ``c`` (the columns ``MEMBER``): of the lines under each key that whose SimHash is nearest to the bits that over half of
    them have."""
    bits = [F.sum(F.shiftrightunsigned("sim", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)]
    votes = members.groupBy("key").agg(F.count("*").alias("n"), *bits)
    most = F.lit(0).cast("long")
    for b in range(64):
        most = most.bitwiseOR(F.when(2 * F.col(f"b{b}") > F.col("n"), F.lit((1 << b) - (1 << 64 if b == 63 else 0))).otherwise(F.lit(0)).cast("long"))
    majority_of = cut(votes.select("key", most.alias("most")))
    far = F.bit_count(F.col("sim").bitwiseXOR(F.col("most")))
    return members.join(majority_of, "key").groupBy("key").agg(F.min(F.struct(far.alias("far"), *MEMBER)).alias("c"))


def linked_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``node``, ``component`` of the lines that verified links of candidates connect (a hash and the smallest one reachable)."""
    members = members_under(lines, shared_keys(lines))
    keys = cut(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    few = members.join(keys.filter(F.col("n") <= FEW).select("key"), "key", "left_semi")
    many = cut(members.join(keys.filter(F.col("n") > FEW).select("key"), "key", "left_semi"))
    centre = centres(many).select(F.col("key").alias("key_c"), *[F.col(f"c.{c}").alias(f"{c}_c") for c in MEMBER])
    stars = many.join(centre, (F.col("key") == F.col("key_c")) & (F.col("h") != F.col("h_c")) & _near("", "_c"))
    pairs = cut(_pairs(few).union(stars.select(F.least("h", "h_c").alias("u"), F.greatest("h", "h_c").alias("v"))).distinct())
    # one scan for the words of all lines that may be compared now or later
    wanted = cut(pairs.select(F.col("u").alias("h")).union(pairs.select("v")).union(many.select("h")).distinct())
    words = stored(words_of_lines(docs, wanted), "words")
    found = connected_components(verified(pairs, words))

    def grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows with the group ``g`` that a line is in so far, keys with the pairs of lines in different groups: ``open``)."""
        held = cut(rows.join(found, rows["h"] == found["node"], "left").select("key", *MEMBER, F.coalesce("component", "h").alias("g")))
        sizes = held.groupBy("key", "g").agg(F.count("*").cast("double").alias("n")).groupBy("key").agg(
            ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("open"))
        return held, cut(sizes.filter("open > 0"))

    held, left = grouped(many)
    rest = _pairs(held.join(left.filter(F.col("open") <= OPEN_PAIRS).select("key"), "key", "left_semi"), "g")
    large = left.filter(F.col("open") > OPEN_PAIRS).select("key")
    if not large.isEmpty():
        split, open_ = grouped(members_split(docs, cut(large)))
        rest = rest.union(_pairs(split.join(open_.select("key"), "key", "left_semi"), "g"))
    return joined_components(found, verified(rest.distinct(), words))


def kept_lines(docs: DataFrame) -> DataFrame:
    """For keyed ``docs`` (``id``, ``th``, ``text``): per ``id``, ``th`` the numbers of the kept lines with words, ``kept``.
    Documents that keep none are not listed."""
    lines = lines_of(docs)
    found = linked_lines(docs, lines)
    named = lines.select("h", "id", "th", "line").join(found.hint("shuffle_hash"), lines["h"] == found["node"], "left")
    first = named.groupBy(F.coalesce("component", "h").alias("g")).agg(F.min(F.struct("id", "th", "line")).alias("at"))
    return first.groupBy(F.col("at.id").alias("id"), F.col("at.th").alias("th")).agg(F.collect_list("at.line").alias("kept"))


def _freed(text: str, kept) -> tuple[str, int, bool]:
    """(text without the lines with words that are not kept, lines removed, whether a word is left)."""
    has = [bool(line.strip()) for line in text.encode("utf-8", "replace").translate(_LINES).split(b"\n")]
    stay = [not h for h in has]
    for i in kept if kept is not None else ():
        stay[i] = True
    removed = len(stay) - sum(stay)
    if not removed:
        return text, 0, any(has)
    return "\n".join(line for line, s in zip(text.split("\n"), stay) if s), removed, any(h and s for h, s in zip(has, stay))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """``docs`` with ``text_col`` freed of repeated lines, and ``lines_removed`` added (or replaced).

    Of each group of like lines the first occurrence stays, by id (null first),
    hash of the text, and line number; all others go. Lines without a word always
    stay; of lines of up to three words only equal ones are alike. Null and empty texts stay as they are. Rows
    with equal id and text are one document and stay alike. With
    ``drop_emptied``, documents that lose lines and keep none with words go. An
    empty table gives an empty result; all other columns pass through, whatever they are called."""
    keyed = small_batches(renamed(docs, id=id_col, text=text_col)).withColumn("th", F.xxhash64("text"))
    kept = kept_lines(keyed).select(F.col("id").alias("key"), F.col("th").alias("key_th"), "kept")
    rest = [c for c in docs.columns if c not in (text_col, "lines_removed")]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"), F.col(text_col).alias("text"), F.col(id_col).alias("id"),
                      F.xxhash64(F.col(text_col)).alias("th"))
    held = own.join(kept.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("key")) & (F.col("th") == F.col("key_th")), "left")

    @F.pandas_udf("text string, removed int, words boolean")
    def cut_lines(texts: pd.Series, keeps: pd.Series) -> pd.DataFrame:
        rows = [(t, 0, False) if t is None else _freed(t, k) for t, k in zip(texts, keeps)]
        text, removed, left = zip(*rows) if rows else ((), (), ())
        return pd.DataFrame({"text": pd.Series(text, dtype=object), "removed": pd.Series(removed, dtype="int32"), "words": pd.Series(left, dtype=bool)})

    done = held.select("rest", cut_lines("text", "kept").alias("done"))
    if drop_emptied:
        done = done.filter(F.col("done.words") | (F.col("done.removed") == 0))
    return done.select(*[F.col("done.text").alias(c) if c == text_col else F.col(f"rest.`{c}`") for c in docs.columns if c in rest or c == text_col],
                       F.col("done.removed").alias("lines_removed"))
