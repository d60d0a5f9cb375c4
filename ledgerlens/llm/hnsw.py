"""Embedding near-duplicates by navigable small-world graphs, one per shard.

The vectors of a label are dealt to shards of about ``SHARD`` vectors, and each
shard gets a hierarchical small-world graph. Every vector queries every shard of
its label: a greedy walk through the upper layers, then a beam over the lowest
one that also follows all vectors within the threshold. In each pair of shards
an exact count over a sample of the queries audits the recall; as long as that
is too low the beams are widened. Links are verified by cosine in double
precision. A pair of shards sends on only link counts and a spanning forest of
its links, whose components are then united over all shards.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_on
from .components import connected_components

SHARD = 2048
NEIGHBOURS = 8          # of a node in upper layers; twice as many in the lowest
LEVEL_ODDS = 16         # one node of so many also stands in the next layer
BEAM = 16
AUDIT_EVERY = 32        # one query of so many is counted exactly
RECALL = 0.995
PAIRS_AT_ONCE = 200_000


def _diverse(order: np.ndarray, own: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates ``order`` (nearest first, -1 none; ``own`` their
    similarities) up to ``most``: first those nearer to the node than to any one
    chosen before, then the nearest of the rest. Returns [node, most], -1 padded."""
    n, k = order.shape
    covered = np.full((n, k), -np.inf, dtype=np.float32)
    chosen = np.zeros((n, k), dtype=bool)
    count = np.zeros(n, dtype=np.int64)
    for c in range(k):
        take = (order[:, c] >= 0) & (covered[:, c] < own[:, c]) & (count < most)
        rows = np.flatnonzero(take)
        if len(rows):
            chosen[rows, c] = True
            count[rows] += 1
            covered[rows] = np.maximum(covered[rows], sims[order[rows, c][:, None], order[rows]])
    rank = np.where(chosen, 0, k) + np.arange(k) + np.where(order < 0, 4 * k, 0)
    best = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(order, best, axis=1)
    return np.pad(out, ((0, 0), (0, max(0, most - out.shape[1]))), constant_values=-1)


def build_layer(x: np.ndarray, most: int) -> np.ndarray:
    """Neighbour lists [node, places] (-1 none) over the rows of ``x`` in their
    order of insertion: a node is linked to diverse nearest ones among those
    before it, links go both ways, lists are pruned to ``2 * most``, and nodes
    that cannot be reached from node 0 get a link from their nearest reachable one."""
    n = len(x)
    sims = x @ x.T
    if n <= 1:
        return np.full((n, 1), -1, dtype=np.int32)
    k = min(n - 1, 4 * most)
    earlier = np.where(np.tri(n, k=-1, dtype=bool), sims, -np.inf)
    near = np.argpartition(-earlier, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(earlier, near, 1), axis=1, kind="stable"), 1)
    own = np.take_along_axis(earlier, near, 1)
    forward = _diverse(np.where(np.isfinite(own), near, -1), own, sims, most)
    a, b = np.nonzero(forward >= 0)[0], forward[forward >= 0]
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((dst, -sims[src, dst], src))
    src, dst = src[order], dst[order]
    first = np.searchsorted(src, np.arange(n))
    place = np.arange(len(src)) - first[src]
    room = 8 * most
    fits = place < room
    lists = np.full((n, room), -1, dtype=np.int64)
    lists[src[fits], place[fits]] = dst[fits]
    own = np.where(lists >= 0, sims[np.arange(n)[:, None], lists], -np.inf).astype(np.float32)
    links = [set(row[row >= 0].tolist()) for row in _diverse(lists, own, sims, 2 * most)]
    reached = np.zeros(n, dtype=bool)

    def walk(start: int) -> None:
        reached[start] = True
        stack = [start]
        while stack:
            for y in links[stack.pop()]:
                if not reached[y]:
                    reached[y] = True
                    stack.append(y)

    walk(0)
    for i in range(n):
        if not reached[i]:
            links[int(np.where(reached, sims[i], -np.inf).argmax())].add(i)
            walk(i)
    width = max(1, max(map(len, links)))
    out = np.full((n, width), -1, dtype=np.int32)
    for i, row in enumerate(links):
        out[i, :len(row)] = sorted(row)
    return out


class Graph:
    """Layers of one shard. ``x``: unit vectors, rows in order of insertion; ``level``: top layer of each."""

    def __init__(self, x: np.ndarray, level: np.ndarray):
        self.x = x.astype(np.float32)
        self.layers = [(np.arange(len(x)), build_layer(self.x, NEIGHBOURS))]
        for k in range(1, int(level.max(initial=0)) + 1):
            nodes = np.flatnonzero(level >= k)
            self.layers.append((nodes, build_layer(self.x[nodes], NEIGHBOURS // 2)))

    def entries(self, q: np.ndarray) -> np.ndarray:
        """Greedy walk down the upper layers: the node at which each query enters the lowest."""
        at = np.full(len(q), self.layers[-1][0][0])
        for nodes, links in self.layers[:0:-1]:
            place = np.searchsorted(nodes, at)
            sim = np.einsum("ij,ij->i", q, self.x[nodes[place]])
            moving = np.arange(len(q))
            while len(moving):
                near = links[place[moving]]
                s = np.einsum("ij,ikj->ik", q[moving], self.x[nodes[near]])
                s[near < 0] = -np.inf
                j = s.argmax(axis=1)
                best = s[np.arange(len(moving)), j]
                better = best > sim[moving]
                place[moving[better]] = near[better, j[better]]
                sim[moving[better]] = best[better]
                moving = moving[better]
            at = nodes[place]
        return at

    def search(self, q: np.ndarray, beam: int, near: float) -> np.ndarray:
        """[query, node] similarities of all visited nodes, -inf elsewhere. Each
        round follows the links of the nodes visited in the last one that are among
        their query's ``beam`` best so far or within ``near``. (That bound only
        rises, so a node below it once need not be looked at again.)"""
        n, m = len(q), len(self.x)
        links = self.layers[0][1]
        sims = np.full(n * m, -np.inf, dtype=np.float32)
        mark = np.zeros(n * m, dtype=np.int32)
        best = np.full((n, beam), -np.inf, dtype=np.float32)
        todo = np.arange(n) * m + self.entries(q)
        sims[todo] = np.einsum("ij,ij->i", q, self.x[todo % m])
        best[:, 0] = sims[todo]
        while len(todo):
            near_by = links[todo % m]
            flat = ((todo // m * m)[:, None] + near_by)[near_by >= 0]
            flat = flat[np.isneginf(sims[flat])]
            order = np.arange(len(flat), dtype=np.int32)
            mark[flat] = order
            flat = np.sort(flat[mark[flat] == order])      # each once, by query
            for a in range(0, len(flat), PAIRS_AT_ONCE):
                part = flat[a:a + PAIRS_AT_ONCE]
                sims[part] = np.einsum("ij,ij->i", q[part // m], self.x[part % m])
            owner, value = flat // m, sims[flat]
            who, first, count = np.unique(owner, return_index=True, return_counts=True)
            if not len(who):
                break
            new = np.full((len(who), int(count.max())), -np.inf, dtype=np.float32)
            row = np.repeat(np.arange(len(who)), count)
            new[row, np.arange(len(flat)) - np.repeat(first, count)] = value
            both = np.concatenate([best[who], new], axis=1)
            best[who] = -np.partition(-both, beam - 1, axis=1)[:, :beam]
            worst = best[who].min(axis=1)
            todo = flat[value >= np.minimum(worst, near)[row]]
        return sims.reshape(n, m)


def _hits(graph: Graph, x: np.ndarray, q: np.ndarray, threshold: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of all pairs found with cosine >= ``threshold`` in double
    precision; beams are widened until the audited queries have their links."""
    near = threshold - 1e-4
    q32 = q.astype(np.float32)
    audit = np.arange(0, len(q), AUDIT_EVERY)
    exact = q[audit] @ x.T >= threshold
    while True:
        sims = graph.search(q32, beam, near)
        found = np.isfinite(sims[audit])[exact].sum()
        if beam >= len(x) or found >= RECALL * exact.sum():
            break
        beam *= 2
    qi, xi = np.nonzero(sims >= near)
    ok = np.zeros(len(qi), dtype=bool)
    for a in range(0, len(qi), PAIRS_AT_ONCE):
        p = slice(a, a + PAIRS_AT_ONCE)
        ok[p] = np.einsum("ij,ij->i", q[qi[p]], x[xi[p]]) >= threshold
    return qi[ok], xi[ok]


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of the pairs that first join two components."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for i, (u, v) in enumerate(zip(a.tolist(), b.tolist())):
        ru, rv = find(u), find(v)
        if ru != rv:
            root[ru] = rv
            out.append(i)
    return out


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard: its ids, unit vectors and top layers, in order of insertion."""
    pdf = pdf.sort_values(["h", "id"], kind="stable")
    x = np.array(pdf["vector"].tolist(), dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)      # lengths neither overflow nor vanish
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    draw = (pdf["h"].to_numpy() & 0xFFFFFFFF) / 2.0 ** 32
    level = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(LEVEL_ODDS)).astype(np.int64)
    return pd.DataFrame({"label": [pdf["label"].iloc[0]], "dim": [x.shape[1]], "shard": [pdf["shard"].iloc[0]],
                         "ids": [pdf["id"].tolist()], "vectors": [x.tobytes()], "level": [level.tobytes()]})


def _matrix(row) -> np.ndarray:
    return np.frombuffer(row.vectors, dtype=np.float64).reshape(-1, int(row.dim))


def _link(threshold: float):
    def link(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = next(left.itertuples()), next(right.itertuples())
        x, q = _matrix(a), _matrix(b)
        graph = Graph(x, np.frombuffer(a.level, dtype=np.int64))
        qi, xi = _hits(graph, x, q, threshold)
        ids_x, ids_q = np.array(a.ids), np.array(b.ids)
        if a.shard == b.shard:
            lo, hi = np.minimum(qi, xi), np.maximum(qi, xi)
            pair = np.unique((lo * len(x) + hi)[lo != hi])       # found from either side
            qi, xi = pair // len(x), pair % len(x)
            forest = _forest(qi, xi)
            counts = [(a.shard, np.bincount(np.concatenate([qi, xi]), minlength=len(x)))]
        else:
            forest = _forest(qi, xi + len(q))
            counts = [(a.shard, np.bincount(xi, minlength=len(x))), (b.shard, np.bincount(qi, minlength=len(q)))]
        rows = [pd.DataFrame({"shard": s, "place": np.flatnonzero(c), "n": c[c > 0]}) for s, c in counts]
        rows.append(pd.DataFrame({"u": ids_q[qi[forest]], "v": ids_x[xi[forest]]}))
        out = pd.concat(rows, ignore_index=True).reindex(columns=["shard", "place", "n", "u", "v"]).astype("Int64")
        return out.assign(label=a.label, dim=a.dim)[["label", "dim", "shard", "place", "n", "u", "v"]]
    return link


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = 0.93, shard: int = SHARD) -> DataFrame:
    """One row per input row: the id, ``n_links`` (other vectors of its label
    found with cosine >= ``threshold``), ``component`` (smallest id reachable).

    Rows whose id, label or vector is null, empty, zero or has a null or
    non-finite component link with nothing and are their own component; so are
    vectors of another length than the rest to these. Rows that share an id are
    vectors of their own that link like any other, and one node of the
    components. An empty table gives an empty result."""
    v = F.col("vector")
    usable = (F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)
              & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
              & F.exists(v, lambda c: F.coalesce(c != 0, F.lit(False))))
    d = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"),
                       F.col(label_col).alias("label"))
    d = d.withColumn("usable", F.coalesce(usable, F.lit(False)))
    good = d.filter("usable").withColumn("dim", F.size(v))
    sizes = cut(good.groupBy("label", "dim").agg(F.ceil(F.count("*") / float(shard)).cast("int").alias("shards")))
    h = F.xxhash64("id")
    dealt = (good.join(sizes, ["label", "dim"]).withColumn("h", h)
             .withColumn("shard", F.pmod(F.xxhash64("h"), F.col("shards")).cast("long")))
    label_type = d.schema["label"].dataType.simpleString()
    built = cut(dealt.select("label", "dim", "shard", "h", "id", "vector").groupBy("label", "dim", "shard").applyInPandas(
        _build, f"label {label_type}, dim int, shard long, ids array<bigint>, vectors binary, level binary"))
    # every vector queries every shard: each pair of a label's shards once, links go both ways
    blocks = built.join(sizes, ["label", "dim"])
    index = blocks.withColumn("j", F.explode(F.sequence(F.col("shard"), F.col("shards") - 1))).withColumn("i", F.col("shard"))
    query = blocks.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shard")))).withColumn("j", F.col("shard"))
    key = ["label", "dim", "i", "j"]
    cols = [F.col(c).alias(c) for c in [*key, "shard", "ids", "vectors", "level"]]
    found = cut(index.select(*cols).groupBy(*key).cogroup(query.select(*cols).groupBy(*key)).applyInPandas(
        _link(threshold), f"label {label_type}, dim int, shard long, place long, n long, u long, v long"))
    counts = found.filter("n is not null").groupBy("label", "dim", "shard", "place").agg(F.sum("n").alias("n_links"))
    groups = connected_components(found.filter("u is not null").select("u", "v"))
    members = built.select("label", "dim", "shard", F.posexplode("ids").alias("place", "id")).withColumn(
        "place", F.col("place").cast("long"))
    linked = members.join(counts, ["label", "dim", "shard", "place"], "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    rows = linked.union(d.filter("not usable").select("id", F.lit(0).cast("long").alias("n_links")))
    return join_on(rows, groups.withColumnRenamed("node", "id"), ["id"], "left").select(
        F.col("id").alias(id_col), "n_links", F.coalesce("component", "id").alias("component"))
