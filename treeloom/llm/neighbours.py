"""Approximate nearest neighbours by largest inner product: a graph built by NN-descent, searched greedily.

Equal vectors are one node; vectors of the largest norm M get a coordinate sqrt(M^2 - |x|^2), which makes near in
inner product and near in angle the same. Index, over every vector:

1. Pivots, a bounded sample, deal each vector to its nearest few cells; oversized cells are dealt again by pivots of
   their own, level by level. The best of a cell are a first graph.
2. Each round of NN-descent lists, for each node, its neighbours and a sample of the nodes that it is a neighbour
   of, joins their vectors, compares them with each other (the neighbours of neighbours), and merges what it finds.
   Nodes with nothing new in their lists have nothing new to compare. Rounds end when less than `changed` of all
   entries are new.

Search, for all queries at once: each enters at the pivots nearest to it, keeps a pool of candidates, expands its best
unexpanded nodes by a join with the graph, and scores what is new, until of all queries' best candidates less than
`changed` are unexpanded. The best of the pool are scored again on the original vectors, in double
precision. Triples of node, neighbour and score travel packed by block of nodes, in numpy arrays.

Left out, both as queries and as candidates: vectors that are null, zero, of another length than most, or that hold a
null or non-finite component. Repeated rows of one id and vector are one row; a null id is left out. Ties of score go to
the smaller id; very long vectors only cost time; an empty table gives an empty result. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BIN, LONG, materialize, struct

PACKED = struct(block=LONG, a=BIN, b=BIN, s=BIN)  # node, neighbour, score
GRAPH = struct(block=LONG, a=BIN, b=BIN, s=BIN, new=BIN)  # new: 1 for entries of the last round
DEALT = struct(cell=LONG, id=LONG, vec=BIN)
ASKED = struct(block=LONG, q=BIN, w=BIN, uq=BIN, uv=BIN)
POOL = struct(block=LONG, a=BIN, b=BIN, s=BIN, done=BIN)


@dataclass(frozen=True)
class Graph:
    neighbours: int = 24
    reverse: int = 24
    rounds: int = 30  # at most; changed ends them
    changed: float = 0.01
    found: int = 3  # best partners that a node gets from one comparison
    cells: int = 4
    cell_rows: int = 500
    pivots: int = 2048
    parts: int = 64  # at most, that one level deals a cell to
    levels: int = 4
    expand: int = 80
    steps: int = 30  # at most; changed ends them
    pool: int = 800
    rescored: int = 100
    entries: int = 32  # pivots at which a query starts


def longs(x) -> np.ndarray:
    return np.concatenate([np.frombuffer(v, np.int64) for v in x]) if len(x) else np.empty(0, np.int64)


def floats(x) -> np.ndarray:
    return np.concatenate([np.frombuffer(v, np.float32) for v in x]) if len(x) else np.empty(0, np.float32)


def halves(x) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float16) for v in x]).astype(np.float32)


def best_of(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int, extra: np.ndarray | None = None):
    """The k best different b of each a, best first; extra (flags) is combined by or for equal pairs."""
    order = np.lexsort((b, a))
    a, b, s = a[order], b[order], s[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, bool)
    flags = np.maximum.reduceat(extra[order], np.flatnonzero(new)) if extra is not None and len(a) else None
    a, b, s = a[new], b[new], s[new]
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    edge = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(edge, np.diff(np.append(edge, len(a))))
    keep = rank < k
    return (a[keep], b[keep], s[keep]) + ((flags[order][keep],) if flags is not None else ())


def by_block(a: np.ndarray, b: np.ndarray, s: np.ndarray, blocks: int) -> pd.DataFrame:
    """Triples as one packed row for each block of a."""
    block = a % blocks
    order = np.argsort(block, kind="stable")
    a, b, s, block = a[order], b[order], s[order].astype(np.float32), block[order]
    ids, first = np.unique(block, return_index=True)
    cut = [*first, len(a)]
    rows = [(i, a[x:y].tobytes(), b[x:y].tobytes(), s[x:y].tobytes()) for i, x, y in zip(ids, cut[:-1], cut[1:], strict=True)]
    return pd.DataFrame(rows, columns=PACKED.names)


def nodes_of(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).filter("vec_id is not null and vector is not null and size(vector) > 0")
    rows = rows.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("vector") == (usual[0].n if usual else 0)).dropDuplicates(["vec_id", "vector"])


def pivots_of(nodes: DataFrame, g: Graph) -> pd.DataFrame:
    """id, vec of a bounded sample of nodes, at most 2 * g.pivots, chosen by a hash."""
    n = nodes.count()
    share = min(1.0, min(g.pivots, max(1, n // (g.cell_rows // 2))) / max(n, 1))
    picked = nodes.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("id", "vec").limit(2 * g.pivots).toPandas()
    return picked if len(picked) else nodes.select("id", "vec").limit(1).toPandas()


def build(nodes: DataFrame, blocks: int, g: Graph, picked: pd.DataFrame | None = None) -> DataFrame:
    """The graph of nodes (id, block, vec): packed triples by block."""
    picked = pivots_of(nodes, g) if picked is None else picked
    context = nodes.sparkSession.sparkContext
    pivots = context.broadcast(halves(picked["vec"]))  # at most 2 * g.pivots vectors
    m = min(g.cells, len(picked))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            near = np.argpartition(-(halves(frame["vec"]) @ pivots.value.T), m - 1, axis=1)[:, :m]
            for k in range(m):
                yield pd.DataFrame({"cell": near[:, k].astype(np.int64), "id": frame["id"], "vec": frame["vec"]})

    dealt = materialize(nodes.select("id", "vec").mapInPandas(deal, DEALT), "cells")
    dealt = small_cells(dealt, g)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        ids, x = frame["id"].to_numpy(), halves(frame["vec"])
        if len(ids) < 2:
            return pd.DataFrame(columns=PACKED.names)
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        k = min(g.neighbours, len(ids) - 1)
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        return by_block(np.repeat(ids, k), ids[top].ravel(), np.take_along_axis(s, top, 1).ravel(), blocks)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        old = np.repeat(frame["old"].to_numpy(), frame["a"].map(len) // 8)
        a, b, s, old = best_of(longs(frame["a"]), longs(frame["b"]), floats(frame["s"]), g.neighbours, old)
        return pd.DataFrame([(frame["block"].iloc[0], a.tobytes(), b.tobytes(), s.astype(np.float32).tobytes(), (1 - old).astype(np.uint8).tobytes())], columns=GRAPH.names)

    def merged(found: DataFrame) -> DataFrame:
        return materialize(found.groupBy("block").applyInPandas(merge, GRAPH), "graph")

    graph = merged(dealt.groupBy("cell").applyInPandas(compare, PACKED).withColumn("old", F.lit(0)))
    for _ in range(g.rounds):
        near = linked(graph, blocks, g, only_new=True).join(nodes.select(F.col("id").alias("other"), "vec"), "other")

        def descend(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["at", "other"], kind="stable")
            at, other, x = frame["at"].to_numpy(), frame["other"].to_numpy(), halves(frame["vec"])
            edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
            out = []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if hi - lo < 2:
                    continue
                ids, s = other[lo:hi], x[lo:hi] @ x[lo:hi].T
                np.fill_diagonal(s, -np.inf)
                k = min(g.found, hi - lo - 1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                out.append((np.repeat(ids, k), ids[top].ravel(), np.take_along_axis(s, top, 1).ravel()))
            return by_block(*(np.concatenate(c) for c in zip(*out, strict=True)), blocks) if out else pd.DataFrame(columns=PACKED.names)

        found = near.groupBy((F.col("at") % blocks).alias("block")).applyInPandas(descend, PACKED)
        graph = merged(found.withColumn("old", F.lit(0)).unionByName(graph.drop("new").withColumn("old", F.lit(1))))
        new, every = graph.select(F.sum(F.length(F.expr("replace(hex(new), '00', '')")) / 2), F.sum(F.octet_length("new"))).head()
        if (new or 0) <= g.changed * (every or 0):
            break
    return graph


def small_cells(dealt: DataFrame, g: Graph) -> DataFrame:
    """Rows of dealt, in cells of at most 2 * g.cell_rows: larger ones are dealt to the nearest of pivots out of themselves,
    as often as g.levels, and by hash only where that leaves one too large (vectors that half precision hardly tells apart)."""
    context, done, wide = dealt.sparkSession.sparkContext, None, 2 * g.cell_rows
    for level in range(g.levels + 1):
        sizes = {r[0]: r[1] for r in dealt.groupBy("cell").count().filter(F.col("count") > wide).collect()}
        large = context.broadcast(sizes)

        def rows_of(big: bool, large=large):
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for frame in batches:
                    yield frame[frame["cell"].isin(large.value) == big]

            return run

        small = dealt.mapInPandas(rows_of(False), DEALT)
        done = small if done is None else done.unionByName(small)
        if not sizes:
            return done
        big = dealt.mapInPandas(rows_of(True), DEALT)
        pivots: dict[int, np.ndarray] = {}
        if level < g.levels:

            def sample(batches: Iterator[pd.DataFrame], large=large, level=level) -> Iterator[pd.DataFrame]:
                for frame in batches:
                    n = frame["cell"].map(large.value).to_numpy(np.float64)
                    share = np.minimum(-(-n // g.cell_rows), g.parts) / np.maximum(n, 1)
                    draw = ((frame["id"].to_numpy() * 2654435761 + level * 97) ^ (frame["cell"].to_numpy() * 40503)) % 1000003 / 1000003
                    yield frame[draw < share]

            picked = big.mapInPandas(sample, DEALT).toPandas()  # at most some g.parts vectors a cell
            pivots = {c: halves(v) for c, v in picked.groupby("cell")["vec"]}
        shared = context.broadcast(pivots)

        def deal(batches: Iterator[pd.DataFrame], shared=shared, large=large, level=level) -> Iterator[pd.DataFrame]:
            for frame in batches:
                for cell, part in frame.groupby("cell"):
                    own = shared.value.get(cell)
                    if own is None or len(own) < 2:
                        to = part["id"].to_numpy() * 2654435761 % 1000003 % -(-large.value[cell] // wide)
                    else:
                        to = (halves(part["vec"]) @ own.T - 0.5 * (own * own).sum(1)).argmax(axis=1)
                    # a hash as name: should two cells ever share one, they are only compared together
                    name = [hash((int(cell), level, int(t))) for t in to]
                    yield pd.DataFrame({"cell": np.array(name, np.int64), "id": part["id"], "vec": part["vec"]})

        dealt = materialize(big.mapInPandas(deal, DEALT), "cells")
    return done.unionByName(dealt)


def linked(graph: DataFrame, blocks: int, g: Graph, only_new: bool = False) -> DataFrame:
    """(at, other): each node's neighbours, and at most g.reverse of the nodes that have it as one. With only_new of the nodes where one of them is new."""

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            a, b = longs(frame["a"]), longs(frame["b"])
            new = np.concatenate([np.frombuffer(v, np.uint8) for v in frame["new"]]) if len(frame) else np.empty(0, np.uint8)
            yield by_block(a, b, 2.0 + new, blocks)
            # a hash in place of the score makes the choice of reverse neighbours a repeatable random one; its last bit is new
            yield by_block(b, a, (((a * 40503) ^ (b * 2654435761)) % 9973 * 2 + new) / 20000.0, blocks)

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        a, b, s = longs(frame["a"]), longs(frame["b"]), floats(frame["s"])
        fa, fb = a[s >= 2], b[s >= 2]
        ra, rb, rs = best_of(a[s < 2], b[s < 2], s[s < 2], g.reverse)
        if only_new:
            asks = np.unique(np.concatenate([a[s == 3], ra[np.rint(rs * 20000).astype(np.int64) % 2 == 1]]))
            f, r = np.isin(fa, asks), np.isin(ra, asks)
            fa, fb, ra, rb = fa[f], fb[f], ra[r], rb[r]
        pairs = np.unique(np.stack([np.concatenate([fa, ra]), np.concatenate([fb, rb])], axis=1), axis=0)
        return pd.DataFrame({"at": pairs[:, 0], "other": pairs[:, 1]})

    return graph.mapInPandas(turn, PACKED).groupBy("block").applyInPandas(choose, struct(at=LONG, other=LONG))


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, blocks: int, g: Graph, picked: pd.DataFrame) -> DataFrame:
    """(q, w): the best nodes found for each query node q, itself among them. queries has id.

    A query enters the graph at the pivots nearest to it, so no node is asked about by every query.
    """
    around = materialize(linked(graph, blocks, g).groupBy("at").agg(F.collect_list("other").alias("others")), "around")
    wanted = materialize(nodes.join(queries, "id", "left_semi").select(F.col("id").alias("q"), F.col("vec").alias("qv")), "wanted")
    pivots = nodes.sparkSession.sparkContext.broadcast((picked["id"].to_numpy(np.int64), halves(picked["vec"])))  # at most 2 * g.pivots

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x = pivots.value
        m = min(g.entries, len(ids))
        for frame in batches:
            if len(frame):
                near = np.argpartition(-(halves(frame["qv"])[:, :-1] @ x[:, :-1].T), m - 1, axis=1)[:, :m]
                frame["others"] = [np.append(ids[row], q) for row, q in zip(near, frame["q"], strict=True)]
                yield frame[["q", "qv", "others"]]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            n = frame["others"].map(len).to_numpy()
            w = np.concatenate(frame["others"].to_list()) if len(frame) else np.empty(0, np.int64)
            q = np.repeat(frame["q"].to_numpy(), n)
            vectors = dict(zip(frame["q"], frame["qv"], strict=True))
            pairs = np.unique(np.stack([w % blocks, q, w], axis=1), axis=0)
            ids, first = np.unique(pairs[:, 0], return_index=True)
            cut, rows = [*first, len(pairs)], []
            for block, x, y in zip(ids, cut[:-1], cut[1:], strict=True):
                uq = np.unique(pairs[x:y, 1])
                rows.append((block, pairs[x:y, 1].tobytes(), pairs[x:y, 2].tobytes(), uq.tobytes(), b"".join(vectors[k] for k in uq)))
            yield pd.DataFrame(rows, columns=ASKED.names)

    def score(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame(columns=POOL.names)
        held = held.sort_values("id")
        ids, x = held["id"].to_numpy(), halves(held["vec"])
        out = []
        for r in asked.itertuples():
            q, w, uq = np.frombuffer(r.q, np.int64), np.frombuffer(r.w, np.int64), np.frombuffer(r.uq, np.int64)
            uv = np.frombuffer(r.uv, np.float16).reshape(len(uq), -1).astype(np.float32).copy()
            uv[:, -1] = 0  # a query has no share in the coordinate that evens out the norms
            at = np.searchsorted(uq, q)
            s = np.concatenate([np.einsum("ij,ij->i", uv[at[k : k + 50_000]], x[np.searchsorted(ids, w[k : k + 50_000])]) for k in range(0, len(q), 50_000)])
            out.append((q, w, s))
        got = by_block(*(np.concatenate(c) for c in zip(*out, strict=True)), blocks)
        got["done"] = [bytes(len(a) // 8) for a in got["a"]]
        return got

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        a, b, s = longs(frame["a"]), longs(frame["b"]), floats(frame["s"])
        done = np.concatenate([np.frombuffer(d, np.uint8) for d in frame["done"]])
        a, b, s, done = best_of(a, b, s, g.pool, done)
        return pd.DataFrame([(frame["block"].iloc[0], a.tobytes(), b.tobytes(), s.tobytes(), done.tobytes())], columns=POOL.names)

    def best_open(block, a, b, s, done):
        """Places of the best g.expand unexpanded candidates of each query; pools are sorted best first."""
        todo = np.flatnonzero(done == 0)
        edge = np.flatnonzero(np.concatenate([[True], a[todo][1:] != a[todo][:-1]])) if len(todo) else todo
        rank = np.arange(len(todo)) - np.repeat(edge, np.diff(np.append(edge, len(todo))))
        return todo[rank < g.expand]

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for r in frame.itertuples():
                a, b, s, done = np.frombuffer(r.a, np.int64), np.frombuffer(r.b, np.int64), np.frombuffer(r.s, np.float32), np.frombuffer(r.done, np.uint8).copy()
                done[best_open(r.block, a, b, s, done)] = 1
                yield pd.DataFrame([(r.block, r.a, r.b, r.s, done.tobytes())], columns=POOL.names)

    def frontier(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for r in frame.itertuples():
                a, b, done = np.frombuffer(r.a, np.int64), np.frombuffer(r.b, np.int64), np.frombuffer(r.done, np.uint8)
                at = best_open(r.block, a, b, None, done)
                yield pd.DataFrame({"q": a[at], "w": b[at]})

    def scored(steps: DataFrame) -> DataFrame:
        asked = steps.mapInPandas(ask, ASKED)
        return asked.groupBy("block").cogroup(nodes.groupBy("block")).applyInPandas(score, POOL)

    first = wanted.mapInPandas(enter, struct(q=LONG, qv=BIN, others=T.ArrayType(LONG)))
    start = first.unionByName(wanted.join(around, wanted.q == around["at"]).select("q", "qv", "others"))
    pool = materialize(scored(start).groupBy("block").applyInPandas(settle, POOL), "pool")
    def unopened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """How many of each query's best candidates are not expanded yet, and how many there are."""
        for frame in batches:
            for r in frame.itertuples():
                a, done = np.frombuffer(r.a, np.int64), np.frombuffer(r.done, np.uint8)
                edge = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
                best = np.arange(len(a)) - np.repeat(edge, np.diff(np.append(edge, len(a)))) < g.rescored
                yield pd.DataFrame({"open": [int((done[best] == 0).sum())], "all": [int(best.sum())]})

    for _ in range(g.steps):
        left, every = pool.mapInPandas(unopened, struct(open=LONG, all=LONG)).agg(F.sum("open"), F.sum("all")).head()
        if (left or 0) <= g.changed * (every or 0):
            break
        open_ = pool.mapInPandas(frontier, struct(q=LONG, w=LONG))
        steps = open_.join(around, open_.w == around["at"]).join(wanted, "q").select("q", "qv", "others")
        pool = materialize(scored(steps).unionByName(pool.mapInPandas(mark, POOL)).groupBy("block").applyInPandas(settle, POOL), "pool")

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            a, b, _ = best_of(longs(frame["a"]), longs(frame["b"]), floats(frame["s"]), g.rescored)
            yield pd.DataFrame({"q": a, "w": b})

    return pool.mapInPandas(top, struct(q=LONG, w=LONG))


def nearest(vectors: DataFrame, query: F.Column, k: int = 20, g: Graph = Graph(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which query (on vec_id) holds."""
    rows = materialize(nodes_of(vectors, id_col, vector_col), "vectors")
    same = materialize(rows.groupBy("vector").agg(F.min("vec_id").alias("id")), "same")
    member = materialize(rows.join(same, "vector").select("id", "vec_id"), "member")
    largest = same.select(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).head()[0]
    n = same.count()
    if not n:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    blocks = max(16, -(-n // 3000))  # of some thousand nodes each: few enough for full arrays, many enough to spread
    length = float(np.sqrt(largest))

    def to_half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)) / length if batch.num_rows else np.empty((0, 1))
            x = np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))]).astype(np.float16)
            ids = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids % blocks), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "block", "vec"])

    nodes = materialize(same.select("id", "vector").mapInArrow(to_half, struct(id=LONG, block=LONG, vec=BIN)), "nodes")
    picked = pivots_of(nodes, g)
    graph = build(nodes, blocks, g, picked)
    asked = member.filter(query).select(F.col("vec_id").alias("query_id"), "id").dropDuplicates(["query_id", "id"])
    found = search(nodes, graph, asked.select("id").distinct(), blocks, g, picked)
    exact = found.join(same.select(F.col("id").alias("q"), F.col("vector").alias("x")), "q").join(same.select(F.col("id").alias("w"), F.col("vector").alias("y")), "w")
    exact = exact.select("q", "w", F.aggregate(F.zip_with("x", "y", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x).alias("score"))
    # of a node's members only the k + 1 smallest ids can be in a list; taken by parts, as one node may have most rows
    part = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // 2000, rows.count() // 5000)))
    few = member.groupBy("id", part.alias("part")).agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    few = few.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    listed = exact.join(few.withColumnRenamed("id", "w"), "w").select("q", F.explode("ids").alias("vec_id"), "score")
    lists = listed.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k + 1).alias("list"))
    lists = materialize(lists, "lists")
    own = asked.join(lists, asked.id == lists.q).select("query_id", F.slice(F.filter("list", lambda r: r["vec_id"] != F.col("query_id")), 1, k).alias("list"))
    out = own.select("query_id", F.posexplode("list"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.minus")).alias("score"))
