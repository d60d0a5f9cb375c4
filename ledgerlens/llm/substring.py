"""Substring deduplication on a compacted De Bruijn graph of words.

Every ``WINDOW`` consecutive words are an edge of the graph (between the first and
the last ``WINDOW`` - 1 of them). Edges travel in chains: consecutive windows whose
smallest ``GRAM``-word hash is the same occurrence. Equal windows have this
``GRAM`` at the same place, so what a chain holds depends on its words alone, and
windows of different ``GRAM`` are never equal.

1. Grams that pick chains are counted; only chains of grams that occur twice
   or more go on. They carry a digest of their words' bytes, taken at their place.
2. Equal chains are one, with their first place, their count and the chains that
   stand before and after them. Two chains that never occur one without the other
   are linked: a join finds the successor whose predecessor it is, and the first
   places must adjoin. Linked chains are one nonbranching path with one first place.
3. Only the heads of paths are looked for in the texts. Where a head stands that
   is not the path's first place, the whole path is a repeated span; the digest of the
   chains there is held against the path's before a word goes.
4. Chains of one gram that differ still share windows (where a repeated passage
   begins or ends). Of each such chain the first place alone is opened into its
   windows, which are edges on their own: counted, first places found, and joined back.

Shuffled are hashes and places; the texts that have spans once, when these are cut out. Each step is written
as a table, and its shuffles go.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import VALUE, groups, look_up, members_of, range_hash
from .common import join_on, renamed, small_batches, stored

WINDOW = 20
GRAM = 6


class Chains:
    """The chains of some texts as arrays: ``doc``, ``start`` (word in the document), ``n`` (windows), ``gram`` (hash)."""

    def __init__(self, texts: list[str], window: int = WINDOW):
        self.window, gram = window, min(GRAM, window)
        norm = [b" ".join(t.encode("utf-8", "surrogatepass").split()) for t in texts]     # bytes: only ASCII space parts words
        self.words = np.array([t.count(b" ") + 1 if t else 0 for t in norm], dtype=np.int64)
        self.data = b"\n".join(norm) + b"\n"
        raw = np.frombuffer(self.data, dtype=np.uint8)
        edge = np.diff(((raw != 32) & (raw != 10)).view(np.int8), prepend=np.int8(0))
        self.first, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        base = np.cumsum(self.words) - self.words
        of = np.repeat(np.arange(len(texts)), self.words)
        left = (base + self.words)[of] - np.arange(len(of))
        valid = np.flatnonzero(left >= window)
        if not len(valid):
            self.doc = self.start = self.n = self.at = valid
            self.gram = np.zeros(0, dtype=np.uint64)
            return
        word = range_hash(VALUE[raw], self.first, self.end, "byte")
        place = np.arange(len(word) - gram + 1)
        hashes = range_hash(word, place, place + gram, "word")
        # smallest gram of each window: 32 bits of its hash, then its place (the leftmost of equals)
        low = hashes & np.uint64(0xFFFFFFFF00000000) | place.astype(np.uint64)
        width, have = window - gram + 1, 1
        while 2 * have <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < width:
            low = np.minimum(low[:have - width], low[width - have:])
        chosen = (low[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (valid[1:] != valid[:-1] + 1)))
        head = np.flatnonzero(new)
        self.at = valid[head]
        self.n = np.diff(np.append(head, len(valid)))
        self.gram = hashes[chosen[head]]
        self.doc = of[self.at]
        self.start = self.at - base[self.doc]

    def digests(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """64-bit digests of the bytes of the words of ``n`` windows from each place ``at`` on."""
        a, b = self.first[at].tolist(), self.end[at + n + self.window - 2].tolist()
        digest, data = xxhash.xxh3_64_intdigest, self.data
        return np.array([digest(data[i:j]) for i, j in zip(a, b)], dtype=np.uint64)


def _scan(docs: DataFrame, emit: Callable[[Chains], tuple[np.ndarray, dict]], fields: dict[str, str], window: int, own: bool = True) -> DataFrame:
    """Rows that ``emit`` makes of the chains of ``docs`` (``id``, ``th``, ``text``): (document of each, arrays of
    ``fields``); with ``own``, each with its document's ``id`` and ``th``."""
    id_type = docs.schema["id"].dataType.simpleString()
    kinds = {"long": pa.int64(), "int": pa.int32()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, texts in groups(batch.column("text")):
                doc, arrays = emit(Chains(texts, window))
                columns = [pa.array(arrays[f].view(np.int64) if t == "long" else arrays[f].astype(np.int32), kinds[t]) for f, t in fields.items()]
                names = list(fields)
                if own:
                    at = pa.array(base + doc, pa.int64())
                    columns = [batch.column("id").take(at), batch.column("th").take(at), *columns]
                    names = ["id", "th", *names]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"{f} {t}" for f, t in fields.items())
    return docs.select("id", "th", "text").mapInArrow(scan, f"id {id_type}, th long, {schema}" if own else schema)


def shared_grams(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``gram``: those that pick more than one chain."""
    def emit(t: Chains):
        gram, n = np.unique(t.gram, return_counts=True)
        return None, {"gram": gram, "n": n}
    counted = _scan(docs, emit, {"gram": "long", "n": "int"}, window, own=False)
    return stored(counted.groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1").select("gram"), "grams")


def chains_of(docs: DataFrame, grams: DataFrame, window: int = WINDOW, around: bool = True) -> DataFrame:
    """``id``, ``th``, ``gram``, ``sig`` (digest of the words), ``start``, ``n`` (windows) of every chain of a
    gram of ``grams`` (and perhaps of others); with ``around`` the chains ``before`` and ``after`` it (gram xor
    sig; 0 for none or one of another gram)."""
    member = members_of(grams, "gram")

    def emit(t: Chains):
        hit = look_up(member)(t.gram)
        gram, start, n, doc = t.gram[hit], t.start[hit], t.n[hit], t.doc[hit]
        sig = t.digests(t.at[hit], n)
        out = {"gram": gram, "sig": sig, "start": start, "n": n}
        if around and len(hit):
            name = gram ^ sig
            adjoin = np.concatenate(((doc[1:] == doc[:-1]) & (start[1:] == start[:-1] + n[:-1]), [False]))
            out["after"] = np.where(adjoin, np.append(name[1:], np.uint64(0)), np.uint64(0))
            out["before"] = np.where(np.concatenate(([False], adjoin[:-1])), np.concatenate((name[:1], name[:-1])), np.uint64(0))
        elif around:
            out["after"] = out["before"] = gram
        return doc, out

    fields = {"gram": "long", "sig": "long", "start": "int", "n": "int"} | ({"before": "long", "after": "long"} if around else {})
    found = _scan(docs, emit, fields, window)
    return found if member else found.join(grams, "gram", "left_semi")


def distinct_chains(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Equal chains as one: ``gram``, ``sig``, ``at`` (first place: id, start, th), ``n``, ``times``, and the only
    chain ``before`` and ``after`` them at all their places (null if these differ)."""
    only = lambda c: F.when(F.min(c) == F.max(c), F.min(c))
    found = chains_of(docs, shared_grams(docs, window), window).groupBy("gram", "sig").agg(
        F.min(F.struct("id", "start", "th")).alias("at"), F.max("n").alias("n"), F.count("*").alias("times"),
        only("before").alias("before"), only("after").alias("after"))
    return stored(found, "chains")


def paths_of(chains: DataFrame) -> DataFrame:
    """Nonbranching paths of repeated chains: ``gram``, ``sig`` of the head, ``at`` (first place), ``windows``, ``check``.

    A chain is linked to the one after it if that stands after it everywhere, has it before it everywhere, and
    adjoins it at the first place. Paths are runs of linked chains along the text of their first place."""
    repeated = chains.filter("times > 1").withColumn("name", F.col("gram").bitwiseXOR(F.col("sig")))
    ahead = repeated.select(F.col("name").alias("name_a"), F.col("after").alias("after_a"), F.col("at").alias("at_a"), F.col("n").alias("n_a"))
    linked = (repeated.filter("before <> 0").join(ahead.filter("after_a <> 0"), (F.col("before") == F.col("name_a")) & (F.col("after_a") == F.col("name"))
                                                  & F.col("at.id").eqNullSafe(F.col("at_a.id")) & (F.col("at.th") == F.col("at_a.th"))
                                                  & (F.col("at.start") == F.col("at_a.start") + F.col("n_a")))
              .select("gram", "sig", F.lit(True).alias("linked")))
    along = Window.partitionBy("at.id", "at.th").orderBy("at.start")
    laid = (repeated.join(linked, ["gram", "sig"], "left")
            .withColumn("path", F.sum(F.when(F.col("linked"), 0).otherwise(1)).over(along)))
    return laid.groupBy("at.id", "at.th", "path").agg(
        F.min_by(F.struct("gram", "sig", "at"), F.col("at.start")).alias("head"), F.sum("n").cast("int").alias("windows"),
        F.bit_xor("sig").alias("check")).select("head.*", "windows", "check")


def repeated_paths(docs: DataFrame, chains: DataFrame, window: int = WINDOW) -> DataFrame:
    """``id``, ``th``, ``start``, ``windows``, ``check`` of every place of a path but its first."""
    paths = stored(paths_of(chains), "paths")
    heads = chains_of(docs, paths.select("gram").distinct(), window, around=False)
    return (heads.join(paths, ["gram", "sig"])
            .filter(~(F.col("id").eqNullSafe(F.col("at.id")) & (F.col("start") == F.col("at.start"))))
            .select("id", "th", "start", "windows", "check"))


def _place(th, start):
    """A hash of a place, of columns or of arrays."""
    if isinstance(th, Column):
        return th.bitwiseXOR(start.cast("long") * F.lit(2654435761))
    return th ^ start.astype(np.uint64) * np.uint64(2654435761)


def _open_windows(docs: DataFrame, opened: DataFrame, window: int, wanted: DataFrame | None = None) -> DataFrame:
    """``id``, ``th``, ``gram``, ``sig`` (digest), ``start`` of the windows of the chains at ``opened`` (places ``id``, ``th``,
    ``start``; perhaps of others, too); with ``wanted`` only of windows in it (and perhaps others)."""
    member, some = members_of(opened, "place"), members_of(wanted, "sig") if wanted is not None else None
    id_type = docs.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has, is_wanted = look_up(member), look_up(some)
        for batch in batches:
            ths = batch.column("th").to_numpy(zero_copy_only=False).view(np.uint64)
            for base, texts in groups(batch.column("text")):
                t = Chains(texts, window)
                hit = has(_place(ths[base + t.doc], t.start))
                n = t.n[hit]
                chain = np.repeat(hit, n)
                step = np.arange(len(chain)) - np.repeat(np.cumsum(n) - n, n)
                sig = t.digests(t.at[chain] + step, np.ones(len(chain), dtype=np.int64))
                keep = is_wanted(sig)
                chain, step, sig = chain[keep], step[keep], sig[keep]
                row = pa.array(base + t.doc[chain], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(row), batch.column("th").take(row), pa.array(t.gram[chain].view(np.int64)), pa.array(sig.view(np.int64)),
                     pa.array((t.start[chain] + step).astype(np.int32)), pa.array(t.start[chain].astype(np.int32))],
                    names=["id", "th", "gram", "sig", "start", "chain"])

    windows = docs.select("id", "th", "text").mapInArrow(scan, f"id {id_type}, th long, gram long, sig long, start int, chain int")
    if member is None:
        windows = join_on(windows, opened.select("id", "th", F.col("start").alias("chain")), ["id", "th", "chain"], "left_semi")
    return windows.drop("chain")


def repeated_windows(docs: DataFrame, chains: DataFrame, window: int = WINDOW) -> DataFrame:
    """``id``, ``th``, ``start``, ``windows`` (1) of the windows at first places of chains that stand earlier in
    another chain of the same gram."""
    several = stored(chains.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("gram"), "several")
    opened = stored(chains.join(several, "gram", "left_semi").select(
        F.col("at.id").alias("id"), F.col("at.th").alias("th"), F.col("at.start").alias("start"), _place(F.col("at.th"), F.col("at.start")).alias("place")), "opened")
    place = F.struct("id", "start")
    first = stored(_open_windows(docs, opened, window).groupBy("gram", "sig").agg(F.min(place).alias("at"), F.max(place).alias("last"))
                   .filter(~F.col("at").eqNullSafe(F.col("last"))).drop("last"), "windows")
    return (_open_windows(docs, opened, window, first).join(first, ["gram", "sig"])
            .filter(~(F.col("id").eqNullSafe(F.col("at.id")) & (F.col("start") == F.col("at.start"))))
            .select("id", "th", "start", F.lit(1).alias("windows"), F.lit(0).cast("long").alias("check")))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``id``, ``th`` (hash of the text), ``start`` (word), ``windows``, ``check`` (0 or the xor of the digests of the
    span's chains): windows from ``start`` on, each of which stands earlier in another place."""
    keyed = _keyed(docs, id_col, text_col)
    chains = distinct_chains(keyed, window)
    return repeated_paths(keyed, chains, window).union(repeated_windows(keyed, chains, window))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return small_batches(renamed(docs, id=id_col, text=text_col)).filter("text is not null").withColumn("th", F.xxhash64("text"))


def _cut_spans(texts: list[str], spans: list[tuple], window: int) -> Iterator[tuple[str, int, int]]:
    """(kept words joined by one space, words, words removed) of texts with their (starts, windows, checks)."""
    t = Chains(texts, window) if spans else None
    edge = np.searchsorted(t.doc, np.arange(len(texts) + 1)) if spans else None
    for d, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").split()
        gone = None
        if spans and spans[d] is not None:
            starts, windows, checks = (np.array(x, dtype=np.int64) for x in spans[d])
            own = t.start[edge[d]:edge[d + 1]]
            whole = np.flatnonzero(checks)      # the words at these spans must be their path's
            a, b = edge[d] + np.searchsorted(own, starts[whole]), edge[d] + np.searchsorted(own, starts[whole] + windows[whole])
            for i, j, k in zip(whole.tolist(), a.tolist(), b.tolist()):
                found = int(np.bitwise_xor.reduce(t.digests(t.at[j:k], t.n[j:k])).view(np.int64)) if k > j else 0
                if found != int(checks[i]):
                    windows[i] = 0
            ok = windows > 0
            mark = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(mark, starts[ok], 1)
            np.add.at(mark, starts[ok] + windows[ok] + window - 1, -1)
            gone = np.cumsum(mark)[:-1] > 0
        kept = words if gone is None else list(compress(words, (~gone).tolist()))
        yield b" ".join(kept).decode("utf-8", "surrogatepass"), len(words), len(words) - len(kept)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with every word removed that is covered by ``window`` consecutive words of its document which
    also start earlier: in a document with a smaller id, or at an earlier word of the same. ``text_col`` holds
    the kept words, joined by one space; ``n_words`` and ``n_removed`` are added (or replaced).

    What is repeated is judged on the input, not on what is left. Words are runs of
    anything but space and \\t \\n \\v \\f \\r. Null texts stay null and have no word. A null id is
    smaller than any other. Rows that share an id are one document as far as order
    goes: of a window at the same word of two such rows neither is earlier, so
    repeated rows stay alike. An empty table gives an empty result; all other columns
    pass through, whatever they are called."""
    spans = stored(repeated_spans(docs, id_col, text_col, window).groupBy("id", "th").agg(F.collect_list(F.struct("start", "windows", "check")).alias("s")).select(
        F.col("id").alias("key"), F.col("th").alias("key_th"), F.col("s.start").alias("starts"), F.col("s.windows").alias("windows"), F.col("s.check").alias("checks")), "spans")
    rest = [c for c in docs.columns if c not in (text_col, "n_words", "n_removed")]
    own = small_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"), F.col(text_col).alias("text"), F.col(id_col).alias("id"),
                                     F.xxhash64(F.col(text_col)).alias("th"))
    member = members_of(spans, "key_th")

    @F.pandas_udf("boolean")
    def may_have(th: pd.Series) -> pd.Series:
        found = np.zeros(len(th), dtype=bool)
        found[look_up(member)(th.to_numpy().view(np.uint64))] = True
        return pd.Series(found)

    on = F.col("id").eqNullSafe(F.col("key")) & (F.col("th") == F.col("key_th"))
    if member:      # texts without a span stay where they are
        marked = own.withColumn("may", may_have("th"))
        held = marked.filter("may").join(spans, on, "left")
        none = [F.lit(None).cast(spans.schema[c].dataType).alias(c) for c in ("starts", "windows", "checks")]
        held = held.select("rest", "text", "starts", "windows", "checks").union(marked.filter("not may").select("rest", "text", *none))
    else:
        held = own.join(spans, on, "left")

    @F.pandas_udf("text string, n_words long, n_removed long")
    def cut_out(texts: pd.Series, starts: pd.Series, windows: pd.Series, checks: pd.Series) -> pd.DataFrame:
        rows = [(None, 0, 0)] * len(texts)
        with_spans = [i for i, (t, s) in enumerate(zip(texts, starts)) if t is not None and s is not None]
        without = [i for i, (t, s) in enumerate(zip(texts, starts)) if t is not None and s is None]
        for i, row in zip(without, _cut_spans([texts[i] for i in without], [], window)):
            rows[i] = row
        for base, some in groups(pa.array([texts[i] for i in with_spans], pa.string())):
            own = with_spans[base:base + len(some)]
            for i, row in zip(own, _cut_spans(some, [(starts[i], windows[i], checks[i]) for i in own], window)):
                rows[i] = row
        text, n_words, n_removed = zip(*rows) if rows else ((), (), ())
        return pd.DataFrame({"text": pd.Series(text, dtype=object), "n_words": pd.Series(n_words, dtype="int64"), "n_removed": pd.Series(n_removed, dtype="int64")})

    done = held.select("rest", cut_out("text", "starts", "windows", "checks").alias("done"))
    return done.select(*[F.col("done.text").alias(c) if c == text_col else F.col(f"rest.`{c}`") for c in docs.columns if c in rest or c == text_col],
                       "done.n_words", "done.n_removed")
