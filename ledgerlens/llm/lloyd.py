"""Lloyd's k-means with exact integers, sharded by dimensions.

Vectors are numbered into chunks and their components into blocks of columns; a
(chunk, block) is one row and lies where its own hash puts it, so the columns of
one vector may be on different machines. A round is four steps: column-block
tasks take the partial squared distances of their rows to their slice of the
centroids; the blocks of a chunk are added and give each vector its nearest
centroid; the choices go back to the column blocks, which sum their columns by
centroid, once for each task and block; each block's sums give the new slice. A
slice belongs to its block: no step needs a whole centroid. Slices are checkpointed
every round, so lineage stays one round long.
"""
from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, renamed

#: Vectors in a chunk, and chunks in a partition of vectors.
CHUNK, CHUNKS = 1024, 8
#: Columns in a block.
WIDTH = 16
#: Bytes of all centroid slices up to which they are broadcast; beyond it they are joined to their blocks by a shuffle.
BROADCAST_BYTES = 8 << 20
#: Components below this in size keep every sum of squares of 64 differences in a long; others are Python integers.
NARROW = 1 << 26


def whole(x: float, scale: int) -> int:
    """floor(scale * x), the product taken as a double."""
    return int(np.floor(np.float64(x) * scale))


def _pack(a: np.ndarray) -> bytes:
    return pickle.dumps(a, protocol=5)


_unpack = pickle.loads      # of what this module packed


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """Rows whose ``vector`` has exactly ``dims`` components, none null or not finite."""
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.filter((F.size("vector") == dims) & F.coalesce(fine, F.lit(False)))


def seeds(vectors: DataFrame, k: int, seed: int) -> list[list[float]]:
    """Components of the ``k`` vectors with the smallest sha256 of ``<seed>:<id>``, in its order
    (ties by the components; rows without an id last)."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    return [r.vector for r in vectors.select(h.alias("h"), "vector").orderBy(F.col("h").asc_nulls_last(), "vector").limit(k).collect()]


def numbered(vectors: DataFrame) -> DataFrame:
    """``vectors`` (checkpointed) with ``chunk`` and ``place``: chunks of at most ``CHUNK`` rows of a partition,
    full ones but for the last of each partition, however the input is dealt."""
    vectors = vectors.repartition(max(1, -(-vectors.count() // (CHUNK * CHUNKS))))
    at = F.monotonically_increasing_id()
    part, row = F.shiftright(at, 33), at.bitwiseAND(F.lit((1 << 33) - 1))
    return cut(vectors.select("id", "vector", (F.shiftleft(part, 33) + F.floor(row / CHUNK)).alias("chunk"),
                              F.pmod(row, F.lit(CHUNK)).cast("int").alias("place")))


def blocks_of(rows: DataFrame, dims: int, scale: int, dtype: type) -> DataFrame:
    """Numbered rows to ``chunk``, ``block``, ``data``: the packed columns (vectors x width) of a block, in the order of ``place``."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, waiting = None, []

        def done():
            x = np.floor(np.array(waiting, dtype=np.float64) * scale)
            x = x.astype(np.int64) if dtype is np.int64 else np.array([[int(v) for v in r] for r in x.tolist()], dtype=object)
            parts = [_pack(np.ascontiguousarray(x[:, a:a + WIDTH])) for a in range(0, dims, WIDTH)]
            return pa.RecordBatch.from_arrays([pa.array([chunk] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()),
                                               pa.array(parts, pa.binary())], names=["chunk", "block", "data"])

        for batch in batches:       # a partition's rows in order: its chunks one after the other
            for c, v in zip(batch.column("chunk").to_pylist(), batch.column("vector").to_pylist()):
                if c != chunk and waiting:
                    yield done()
                    waiting = []
                chunk = c
                waiting.append(v)
        if waiting:
            yield done()

    return rows.select("chunk", "vector").mapInArrow(split, "chunk long, block int, data binary")


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Column blocks with their slice of the centroids to partial squared distances (vectors x centroids)."""
    for batch in batches:
        out = []
        for data, piece in zip(batch.column("data").to_pylist(), batch.column("slice").to_pylist()):
            x, c = _unpack(data), _unpack(piece)
            out.append(_pack(np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)))
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(out, pa.binary())], names=["chunk", "part"])


def _nearest(table: pa.Table) -> pa.Table:
    """The partial distances of one chunk, added: the nearest centroid (the smaller number on ties) and its distance."""
    total = None
    for part in table.column("part").to_pylist():
        part = _unpack(part)
        total = part if total is None else total + part
    who = total.argmin(axis=1) if total.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in total])
    best = total[np.arange(len(total)), who]
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "who": pa.array([_pack(who.astype(np.int32))], pa.binary()),
                     "best": pa.array([_pack(best)], pa.binary())})


def assigned(blocks: DataFrame, slices: DataFrame, small: bool) -> DataFrame:
    """``chunk``, ``who``, ``best`` (packed: a centroid and a squared distance for each vector of the chunk)."""
    held = blocks.join(F.broadcast(slices) if small else slices, "block")
    parts = held.select("chunk", "data", "slice").mapInArrow(_partial, "chunk long, part binary")
    return parts.groupBy("chunk").applyInArrow(_nearest, "chunk long, who binary, best binary")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Column blocks and their vectors' centroids to sums and counts by centroid, one row a block that the task saw."""
    sums: dict[int, list] = {}
    for batch in batches:
        for block, data, who, k in zip(*[batch.column(c).to_pylist() for c in ("block", "data", "who", "k")]):
            x, who = _unpack(data), _unpack(who)
            if block not in sums:
                sums[block] = [np.zeros((k, x.shape[1]), dtype=x.dtype), np.zeros(k, dtype=np.int64)]
            total, count = sums[block]
            np.add.at(total, who, x)
            count += np.bincount(who, minlength=k)
    yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([_pack(v) for v in sums.values()], pa.binary())], names=["block", "sums"])


def _update(key: tuple, table: pa.Table) -> pa.Table:
    """One block's sums of all tasks and its old slice to its new slice."""
    total = count = None
    for packed in table.column("sums").to_pylist():
        s, n = _unpack(packed)
        total, count = (s, n) if total is None else (total + s, count + n)
    new = _unpack(table.column("slice")[0].as_py()).copy()
    for j in np.flatnonzero(count):
        new[j] = total[j] // int(count[j])      # floor, also below zero
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "slice": pa.array([_pack(new)], pa.binary())})


def moved(blocks: DataFrame, choice: DataFrame, slices: DataFrame, k: int, n_blocks: int, small: bool) -> DataFrame:
    """New slices: every centroid the floor of the mean of its vectors, those without one as they were."""
    back = choice.select("chunk", "who", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    sums = (blocks.join(back, ["chunk", "block"]).select("block", "data", "who", F.lit(k).alias("k"))
            .mapInArrow(_sums, "block int, sums binary"))
    return cut(sums.join(F.broadcast(slices) if small else slices, "block").groupBy("block").applyInArrow(_update, "block int, slice binary"))


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10,
            dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """Clusters of the usable vectors: ``id_col``, ``cluster``, ``distance`` (squared, to its centroid),
    ``cluster_inertia``, ``inertia``, ``centroid_sha256``.

    Usable are vectors of exactly ``dims`` components, none null, NaN or infinite;
    no row comes back for others. Components become floor(``scale`` * x). The first
    centroids are the vectors with the smallest sha256 of ``<seed>:<id>``; of fewer
    than ``k`` usable vectors, all. Ties go to the smaller number; a centroid
    without vectors stays. Repeated rows and rows that share an id count each; null
    ids are vectors like others, but first centroids only after all others. A sum
    or distance that no long holds is null (such components are Python integers on
    the way, so assignments stay exact). An empty table gives an empty result;
    further columns are not touched."""
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = (f"{id_col} {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    kept = numbered(usable(renamed(vectors, id=id_col, vector=vector_col), dims).select("id", F.col("vector").cast("array<double>").alias("vector")))
    largest = kept.select(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))).alias("m")).first().m
    if largest is None:
        return spark.createDataFrame([], schema)
    dtype = np.int64 if largest * scale < NARROW else object
    start = np.array([[whole(x, scale) for x in v] for v in seeds(kept, k, seed)], dtype=dtype)
    k = len(start)
    n_blocks = -(-dims // WIDTH)
    small = k * dims * 8 <= BROADCAST_BYTES
    blocks = cut(blocks_of(kept, dims, scale, dtype)).repartition("chunk", "block").persist()
    try:
        slices = cut(spark.createDataFrame([(b, _pack(np.ascontiguousarray(start[:, b * WIDTH:(b + 1) * WIDTH]))) for b in range(n_blocks)],
                                           "block int, slice binary"))
        for _ in range(rounds):
            slices = moved(blocks, assigned(blocks, slices, small), slices, k, n_blocks, small)
        choice = cut(assigned(blocks, slices, small))
    finally:
        blocks.unpersist()
    return _result(kept, choice, slices, id_col, id_type).select(*[c.split()[0] for c in schema.split(", ")])


def _result(kept: DataFrame, choice: DataFrame, slices: DataFrame, id_col: str, id_type: str) -> DataFrame:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, who, best in zip(*[batch.column(c).to_pylist() for c in ("chunk", "who", "best")]):
                who, best = _unpack(who), _unpack(best)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(who), pa.int64()), pa.array(range(len(who)), pa.int32()), pa.array(who),
                     pa.array([str(int(x)) for x in best])], names=["chunk", "place", "cluster", "distance"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, list] = {}
        for batch in batches:
            for j, n, piece in zip(*[batch.column(c).to_pylist() for c in ("j", "block", "piece")]):
                slices.setdefault(j, []).append((n, piece))
        out = {j: hashlib.sha256(",".join(p for _, p in sorted(own)).encode()).hexdigest() for j, own in slices.items()}
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32()), pa.array(list(out.values()), pa.string())], names=["cluster", "centroid_sha256"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, piece in zip(batch.column("block").to_pylist(), batch.column("slice").to_pylist()):
                rows = [",".join(str(int(x)) for x in r) for r in _unpack(piece)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([b] * len(rows), pa.int32()), pa.array(rows)],
                                                 names=["j", "block", "piece"])

    hashes = slices.mapInArrow(pieces, "j int, block int, piece string").repartition("j").mapInArrow(joined, "cluster int, centroid_sha256 string")
    flat = (choice.mapInArrow(spread, "chunk long, place int, cluster int, distance string")
            .withColumn("distance", F.col("distance").try_cast("decimal(38,0)")))
    whole_sum = F.when(F.count("distance") == F.count("*"), F.try_sum("distance"))      # null if one is too large
    by = cut(flat.groupBy("cluster").agg(whole_sum.alias("own")))
    total = by.agg(F.when(F.count("own") == F.count("*"), F.try_sum("own")).alias("total"))
    long = lambda c: F.col(c).try_cast("long")
    per = by.select("cluster", long("own").alias("cluster_inertia"), total.scalar().try_cast("long").alias("inertia")).join(hashes, "cluster")
    return (flat.join(kept.select("chunk", "place", F.col("id").alias(id_col)), ["chunk", "place"]).join(per, "cluster")
            .withColumn("distance", long("distance")))
