"""Source divergence audit by in-mapper stripes.

Every partition folds whole documents into stripes: for each language and term
the number of documents that hold it and its count in each source. A task keeps
its stripes as hashes and spills them, sorted for merging, when they hold
``STRIPE_ENTRIES`` entries. Spilled stripes meet by (language, term), sorted, so a
task merges them one after the other and holds one at a time; a term that every
document holds has one stripe for each spill, however often it stands. Merged
stripes of terms in enough documents are kept (a written checkpoint) and emit the
divergences directly: sums for each pair of sources and the terms a source uses
more than its language. Only sums and counts are shuffled after that.

All arithmetic is in integers. Shares are billionths: with N the count of all
kept terms and V their number, a term counted c times has
p = 1 + floor(10**9 * (c + 1) / (N + V)); the divergence of p from q is
floor((p - q)**2 / q).
"""
from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, renamed, small_batches

#: Entries (term, source) of the stripes a task holds before it spills them.
STRIPE_ENTRIES = 1_500_000
#: Stripes in a batch that a task sends on; entries that it merges at once.
ROWS_AT_ONCE, ENTRIES_AT_ONCE = 20_000, 400_000
#: Bytes of a text whose terms are counted at once.
PIECE = 1 << 20
#: Sources whose divergences from one another are summed in one pass over the stripes.
BLOCK = 512
#: Terms of stripes laid out as a table (terms x sources) at once.
TERMS_AT_ONCE = 4096
#: Terms listed of each source.
TOP_TERMS = 200

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_STRIPES = "lang string, term string, df long, sources array<string>, counts array<long>"
_ARROW = pa.schema([("lang", pa.string()), ("term", pa.string()), ("df", pa.int64()),
                    ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def pieces_of(text: str) -> Iterator[list[bytes]]:
    """Terms of a text, a piece of it at a time: runs of ASCII letters (A-Z in lower case) and characters beyond ASCII."""
    data = text.encode("utf-8", "replace").translate(_LETTERS)
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            near = data.rfind(b" ", at, end)
            end = near if near > at else data.find(b" ", end)
            end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _stripes(lang: list[str] | pa.Array, term: pa.Array, df: np.ndarray, upto: np.ndarray, sources: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    """Stripes whose entries end at ``upto`` in ``sources`` and ``counts``."""
    ends = pa.array(np.concatenate(([0], upto)).astype(np.int32))
    return pa.RecordBatch.from_arrays([lang if isinstance(lang, pa.Array) else pa.array(lang, pa.string()), term, pa.array(df),
                                       pa.ListArray.from_arrays(ends, sources), pa.ListArray.from_arrays(ends, pa.array(counts))], schema=_ARROW)


class Stripes:
    """Stripes of one task: for each language the documents and, by source, the count of each term."""

    def __init__(self):
        self.df: dict[str, Counter] = defaultdict(Counter)
        self.counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))

    def fold(self, lang: str, source: str, text: str) -> None:
        seen: set[bytes] = set()
        count = self.counts[lang][source]
        for terms in pieces_of(text):
            count.update(terms)
            seen.update(terms)
        self.df[lang].update(seen)

    def entries(self) -> int:
        return sum(len(c) for by in self.counts.values() for c in by.values())

    def spill(self) -> Iterator[pa.RecordBatch]:
        for lang, df in self.df.items():
            by_source = list(self.counts[lang].items())
            terms = list(df)
            place = dict(zip(terms, range(len(terms))))
            row = np.fromiter((place[t] for _, c in by_source for t in c), dtype=np.int64)
            count = np.fromiter((n for _, c in by_source for n in c.values()), dtype=np.int64)
            source = np.repeat(np.arange(len(by_source)), [len(c) for _, c in by_source])
            order = np.argsort(row, kind="stable")
            upto = np.cumsum(np.bincount(row, minlength=len(terms)))
            names = pa.array([name for name, _ in by_source], pa.string())
            n_docs = np.fromiter(df.values(), dtype=np.int64, count=len(df))
            del place, row
            for first in range(0, len(terms), ROWS_AT_ONCE):
                last = min(first + ROWS_AT_ONCE, len(terms))
                begin = upto[first - 1] if first else 0
                own = order[begin:upto[last - 1]]
                yield _stripes([lang] * (last - first), pa.array(terms[first:last], pa.binary()).cast(pa.string()), n_docs[first:last],
                               upto[first:last] - begin, names.take(pa.array(source[own])), count[own])
        self.__init__()


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stripes = Stripes()
    for batch in batches:
        room = 0
        for lang, source, text in zip(*[batch.column(c) for c in ("lang", "source", "text")]):
            text = text.as_py()
            stripes.fold(lang.as_py(), source.as_py(), text)
            room += len(text)
            if room > PIECE:
                room = 0
                if stripes.entries() > STRIPE_ENTRIES:
                    yield from stripes.spill()
    yield from stripes.spill()


def _merged(table: pa.Table) -> pa.RecordBatch:
    """Rows in the order of their keys to one stripe for each key."""
    table = table.combine_chunks()
    lang, term, df, sources, counts = [c.chunk(0) for c in table.columns]
    new = np.ones(len(lang), dtype=bool)
    if len(lang) > 1:
        differ = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1]))
        new[1:] = differ.to_numpy(zero_copy_only=False)
    head = np.flatnonzero(new)
    key = np.cumsum(new) - 1
    row = np.repeat(key, pc.list_value_length(sources).to_numpy(zero_copy_only=False))
    coded = sources.flatten().dictionary_encode()
    count, width = counts.flatten().to_numpy(), max(1, len(coded.dictionary))
    entry = row * width + coded.indices.to_numpy()
    order = np.argsort(entry, kind="stable")
    entry = entry[order]
    first = np.flatnonzero(np.concatenate(([True], entry[1:] != entry[:-1]))) if len(entry) else np.zeros(0, dtype=np.int64)
    total = np.add.reduceat(count[order], first) if len(first) else np.zeros(0, dtype=np.int64)
    upto = np.cumsum(np.bincount(entry[first] // width, minlength=len(head)))
    at = pa.array(head)
    return _stripes(lang.take(at), term.take(at), np.add.reduceat(df.to_numpy(), head), upto, coded.dictionary.take(pa.array(entry[first] % width)), total)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes in the order of their keys, a key's perhaps far apart in many batches, to one stripe for each key."""
    waiting, entries = [], 0
    for batch in batches:
        if not len(batch):
            continue
        waiting.append(batch)
        entries += len(batch) + len(batch.column(3).flatten())
        if entries >= ENTRIES_AT_ONCE:
            done = _merged(pa.Table.from_batches(waiting, _ARROW))
            if len(done) > 1:
                yield done.slice(0, len(done) - 1)
            waiting, entries = [done.slice(len(done) - 1)], 0       # its key may go on
    if waiting:
        yield _merged(pa.Table.from_batches(waiting, _ARROW))


def stripes_of(docs: DataFrame, min_docs: int = 3) -> DataFrame:
    """Merged stripes (``lang``, ``term``, ``df``, ``sources``, ``counts``) of the terms that
    stand in at least ``min_docs`` documents of their language, as a written checkpoint.
    ``docs``: ``lang``, ``source``, ``text`` without nulls."""
    spilled = docs.select("lang", "source", "text").mapInArrow(_fold, _STRIPES)
    merged = (spilled.repartition("lang", "term").sortWithinPartitions("term", "lang")
              .mapInArrow(_merge, _STRIPES).filter(F.col("df") >= min_docs))
    return cut(merged)


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / total), exactly: a long division by thousands. 0 < count + 1 <= total < 9e15."""
    left, out = count + 1, np.zeros(np.broadcast(count, total).shape, dtype=np.int64)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // total
        left = left % total
    return out + 1


def away(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / q) for shares of at most 10**9 + 1."""
    return (p - q) ** 2 // q


def _tables(batches: Iterator[pa.RecordBatch], at: dict[str, dict[str, int]]) -> Iterator[tuple[str, np.ndarray]]:
    """(language, table of counts: terms x sources) for ``TERMS_AT_ONCE`` terms of a language at most.
    ``at``: column of each source to use."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        sizes = pc.list_value_length(batch.column("sources")).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(batch)), sizes)
        coded, count = batch.column("sources").flatten().dictionary_encode(), batch.column("counts").flatten().to_numpy()
        code = langs.indices.to_numpy()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            if lang not in at:
                continue
            columns = np.array([at[lang].get(s, -1) for s in coded.dictionary.to_pylist()], dtype=np.int64)
            mine = np.flatnonzero(code == k)
            place = np.full(len(batch), -1, dtype=np.int64)
            place[mine] = np.arange(len(mine))
            use = place[row] >= 0
            r, c, n = place[row[use]], columns[coded.indices.to_numpy()[use]], count[use]
            known = c >= 0
            r, c, n = r[known], c[known], n[known]
            for first in range(0, len(mine), TERMS_AT_ONCE):
                here = slice(*np.searchsorted(r, (first, first + TERMS_AT_ONCE)))
                table = np.zeros((min(TERMS_AT_ONCE, len(mine) - first), len(at[lang])), dtype=np.int64)
                table[r[here] - first, c[here]] = n[here]
                yield lang, table


def _large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined to about ``TERMS_AT_ONCE`` rows."""
    waiting = []
    for batch in batches:
        waiting.append(batch)
        if sum(map(len, waiting)) >= TERMS_AT_ONCE:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting = []
    if sum(map(len, waiting)):
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def pair_sums(stripes: DataFrame, rows: list[tuple], columns: list[tuple]) -> DataFrame:
    """``lang``, ``source``, ``item``, ``value``: for each source of ``rows`` and other source of
    ``columns`` of its language the divergences summed over a task's terms (none for 0). Both lists,
    of (language, source, N + V), are blocks of bounded length, so a task's sums are, too."""
    places = {}
    for lang, source, total in [*rows, *columns]:
        places.setdefault(lang, {}).setdefault(source, total)
    at = {lang: {s: i for i, s in enumerate(own)} for lang, own in places.items()}
    left = {lang: [at[lang][s] for g, s, _ in rows if g == lang] for lang in at}
    right = {lang: [at[lang][s] for g, s, _ in columns if g == lang] for lang in at}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = {lang: np.zeros((len(left[lang]), len(right[lang])), dtype=np.int64) for lang in at if left[lang] and right[lang]}
        for lang, table in _tables(_large(batches), at):
            if lang in done:
                p = share(table, np.array(list(places[lang].values()), dtype=np.int64))
                for k, i in enumerate(left[lang]):
                    done[lang][k] += away(p[:, [i]], p[:, right[lang]]).sum(axis=0)
        for lang, total in done.items():
            names = list(places[lang])
            out = [(names[i], names[j], int(total[k, m])) for k, i in enumerate(left[lang]) for m, j in enumerate(right[lang]) if i != j and total[k, m]]
            if out:
                source, item, value = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), pa.array(source, pa.string()),
                                                  pa.array(item, pa.string()), pa.array(value, pa.int64())],
                                                 names=["lang", "source", "item", "value"])

    return stripes.select("lang", "sources", "counts").mapInArrow(sums, "lang string, source string, item string, value long")


def term_values(stripes: DataFrame, sources: list[tuple], langs: dict[str, int]) -> DataFrame:
    """``lang``, ``source``, ``item``, ``value``: each kept term that a source of ``sources`` uses
    and uses more than its language does. ``sources``: (language, source, N + V); ``langs``: N + V of languages."""
    totals = {(lang, source): total for lang, source, total in sources}

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _large(batches):
            sizes = pc.list_value_length(batch.column("sources")).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(batch)), sizes)
            lang = batch.column("lang").dictionary_encode()
            name = batch.column("sources").flatten().dictionary_encode()
            count = batch.column("counts").flatten().to_numpy()
            whole = np.zeros(len(batch), dtype=np.int64)
            np.add.at(whole, row, count)
            code = lang.indices.to_numpy()
            of_lang = np.array([langs.get(g, 0) for g in lang.dictionary.to_pylist()], dtype=np.int64)
            of_source = np.array([[totals.get((g, s), 0) for s in name.dictionary.to_pylist()] for g in lang.dictionary.to_pylist()],
                                 dtype=np.int64).reshape(len(lang.dictionary), -1)
            total = of_source[code[row], name.indices.to_numpy()]
            use = np.flatnonzero((total > 0) & (count > 0))
            p, q = share(count[use], total[use]), share(whole[row[use]], of_lang[code[row[use]]])
            more = p > q
            use, f = use[more], away(p[more], q[more])
            at = pa.array(row[use])
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(at), name.dictionary.take(name.indices.take(pa.array(use))),
                                              batch.column("term").take(at), pa.array(f)], names=["lang", "source", "item", "value"])

    return stripes.select("lang", "term", "sources", "counts").mapInArrow(values, "lang string, source string, item string, value long")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          min_docs: int = 3, top: int = TOP_TERMS) -> DataFrame:
    """Divergences of the sources of each language: ``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.

    Part ``pair`` has a row for each other source of the language, summed over all
    kept terms (0 where none is kept); part ``term`` the ``top`` terms that the source
    uses more than its language, by divergence. Ranks go from 1 by value, largest
    first, then by item in the order of its UTF-8 bytes.

    Null languages, sources and texts are the empty string; empty texts belong to
    their group and add no term. Repeated rows are documents each. An empty table
    gives an empty result; further columns are not touched. Pairs are as many as the
    sources of a language squared, which is the result's size; sources are taken in
    blocks of ``BLOCK``, each pair of blocks in one pass over the stripes."""
    spark = docs.sparkSession
    blank = F.lit("")
    d = small_batches(renamed(docs, text=text_col, lang=lang_col, source=source_col)).select(
        *[F.coalesce(F.col(c).cast("string"), blank).alias(c) for c in ("lang", "source", "text")])
    stripes = stripes_of(d, min_docs)
    per_source = stripes.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy(
        "lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    per_lang = stripes.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    groups = (d.select("lang", "source").distinct().join(per_source, ["lang", "source"], "left").join(
        per_lang.select("lang", "v"), "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")))
    groups = cut(groups.repartitionByRange("lang", "source").sortWithinPartitions("lang", "source"))

    def blocks() -> Iterator[list[tuple]]:
        """Groups in order, ``BLOCK`` at a time: (language, source, N + V)."""
        block = []
        for r in groups.coalesce(8).toLocalIterator():
            block.append((r.lang, r.source, r.n + r.v))
            if len(block) == BLOCK:
                yield block
                block = []
        if block:
            yield block

    empty = spark.createDataFrame([], "lang string, source string, item string, value long")
    pairs = terms = empty
    for mine in blocks():
        own = {lang for lang, _, _ in mine}
        totals = {r.lang: r.n + r.v for r in per_lang.filter(F.col("lang").isin(list(own))).collect()}
        terms = terms.union(term_values(stripes, mine, totals))
        for others in blocks():
            if own & {lang for lang, _, _ in others}:
                pairs = pairs.union(pair_sums(stripes, mine, others))
    none = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    pairs = (pairs.union(none.select("lang", "source", "item", F.lit(0).cast("long").alias("value")))
             .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked_pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    ranked_terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value",
                                F.row_number().over(best).alias("rank")).filter(F.col("rank") <= top)
    return ranked_pairs.union(ranked_terms)
