"""Hard-negative mining by distributed radix selection.

An anchor's kth best score among many rows is found digit by digit: every block of anchors meets every slice of rows,
a histogram of the scores in each anchor's window is added up over the slices, the bucket that holds the kth score
becomes the next, narrower window, and so on, by score and then, where scores tie, by id. It ends when at most SLACK
rows more than wanted are left; only then rows are gathered, those few, and ranked. So neither a hot label nor a third
of all rows with one vector makes more than that for a task to hold. First the positives of each anchor are selected
(rows of its label), then for each anchor and positive the negatives (rows of other labels in a window of scores that
the positive's score sets).

A slice reports its best buckets only, until they hold as many rows as are wanted: what lies below can't hold the kth.
Scores are made anew in each pass, in blocks; anchors are a stated set, a block of them is one key's rows.

Rows with a null id, label or vector, or with a null or non-finite component, take no part, nor do vectors whose scaled
length exceeds 2^30 (their products might not fit into 64 bits). Shorter vectors count as filled up with zeros; repeated
rows are rows of their own, as long as their ids differ: rows of one id are one row, the first by label and vector;
ids lie within 2^62 of each other. Other columns are ignored, whatever their names; an empty table gives an empty
result. Products are exact integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LONG, ceil_div, materialize, struct

BUCKETS_LOG2 = 10
SLACK = 16
ANCHORS_A_BLOCK, ROWS_A_SLICE = 1024, 2048
LIMIT = 1 << 30
NOT_HERE = -(1 << 62)
#: A window of an anchor: scores lo .. hi and, if lo = hi, ids id_lo .. id_hi, of which want rows are looked for in
#: buckets of width step. best: the highest score of the whole selection, whose rows above hi are all taken.
WINDOW = struct(anchor=LONG, win=LONG, lo=LONG, hi=LONG, id_lo=LONG, id_hi=LONG, want=LONG, best=LONG, step=LONG)


@dataclass(frozen=True)
class Mining:
    scale: int = 256
    positives: int = 5
    negatives: int = 3
    least: int = 50  # percent of the positive's score
    most: int = 95


def scaled(rows: DataFrame, scale: int, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(id, label, v): rows that take part, components as whole numbers; one row an id."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("double"))
    out = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.when(finite, whole).alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    out = out.filter("id is not null and label is not null and v is not null").filter(length <= float(LIMIT) ** 2)
    first = F.min(F.struct("label", "v")).alias("s")
    return out.groupBy("id").agg(first).select("id", "s.label", F.col("s.v").cast("array<int>").alias("v"))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows of one width, filled up with zeros."""
    sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = np.concatenate(list(vectors))
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products; in doubles where these are exact, and in 64-bit integers otherwise."""
    most = np.abs(a).max(initial=0).item() * np.abs(b).max(initial=0).item() * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Blocks:
    """Every block of anchors with every slice of rows, as groups of Spark's."""

    def __init__(self, rows: DataFrame, anchors: DataFrame):
        self.width = int(rows.agg(F.max(F.size("v"))).first()[0] or 0)
        self.blocks, self.slices = (max(1, ceil_div(t.count(), most)) for t, most in ((anchors, ANCHORS_A_BLOCK), (rows, ROWS_A_SLICE)))
        part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        self.rows = rows.select(part(self.slices).alias("slice"), "id", "label", "v")
        self.anchors = materialize(anchors.select(part(self.blocks).alias("block"), F.col("id").alias("anchor"), F.col("label").alias("own"), F.col("v").alias("u")), "anchors")

    def windows(self, state: DataFrame, same: bool, run: Callable[[np.ndarray, np.ndarray, tuple], Iterable[tuple[int, int]]], names: tuple[str, str]) -> DataFrame:
        """(anchor, win) and run's pairs for each window of state with each slice. run gets the slice's ids and their scores, NOT_HERE where the label is not the anchor's own (same) or is (not same)."""
        width, columns = self.width, ("anchor", "win", *names)

        def of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(left) and len(right):
                ids, labels = right["id"].to_numpy(np.int64), right["label"].to_numpy(np.int64)
                owners, at, owner_of = np.unique(left["anchor"].to_numpy(np.int64), return_index=True, return_inverse=True)
                scores = products(matrix(left["u"].iloc[at], width), matrix(right["v"], width))
                own = left["own"].to_numpy(np.int64)[at]
                scores[((own[:, None] == labels) != same) | (owners[:, None] == ids)] = NOT_HERE
                for a, w in zip(owner_of.tolist(), zip(*(left[c].tolist() for c in WINDOW.names), strict=True), strict=True):
                    out += [(*w[:2], *r) for r in run(ids, scores[a], w)]
            return pd.DataFrame(out, columns=columns).astype("int64")

        left = self.anchors.join(state, "anchor").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(self.slices - 1))))
        right = self.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))))
        return left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInPandas(of, struct(**{c: LONG for c in columns}))


def best_buckets(ids: np.ndarray, scores: np.ndarray, w: tuple) -> Iterable[tuple[int, int]]:
    """(bucket, count) of a slice's rows in a window, best first, until the wanted number is reached."""
    _, _, lo, hi, id_lo, id_hi, want, _, step = w
    if lo < hi:
        b = (hi - scores[(scores >= lo) & (scores <= hi)]) // step
    else:
        b = (ids[(scores == lo) & (ids >= id_lo) & (ids <= id_hi)] - id_lo) // step
    if len(b) > want:
        b = b[b <= np.partition(b, want - 1)[want - 1]]
    return zip(*(c.tolist() for c in np.unique(b, return_counts=True)), strict=True)


def qualifying(ids: np.ndarray, scores: np.ndarray, w: tuple) -> Iterable[tuple[int, int]]:
    """(id, score) of a slice's rows that are taken or in the last bucket."""
    _, _, lo, _, _, id_hi, _, best, _ = w
    keep = (scores <= best) & ((scores > lo) | ((scores == lo) & (ids <= id_hi)))
    return zip(ids[keep].tolist(), scores[keep].tolist(), strict=True)


def with_step(state: DataFrame) -> DataFrame:
    """Adds the width, a power of two, of about 2^BUCKETS_LOG2 equal parts of the window."""
    wide = "case when lo < hi then cast(hi as double) - lo else cast(id_hi as double) - id_lo end"
    return state.withColumn("step", F.expr(f"shiftleft(1L, greatest(0, cast(ceil(log2(1 + {wide})) as int) - {BUCKETS_LOG2}))"))


def narrowed(state: DataFrame, counts: DataFrame) -> DataFrame:
    """The windows after a digit: the bucket with the kth row, what is still wanted of it, and left: how many rows it has (null: a window with fewer than wanted, which stays)."""
    order = Window.partitionBy("anchor", "win").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.groupBy("anchor", "win", "bucket").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(order))
    kth = upto.join(state.select("anchor", "win", "want"), ["anchor", "win"]).filter("upto >= want and upto - n < want")
    out = state.join(kth.select("anchor", "win", "bucket", F.col("n").alias("left"), F.expr("upto - n").alias("taken")), ["anchor", "win"], "left")
    new = {
        "hi": "if(bucket is not null and lo < hi, hi - bucket * step, hi)",
        "lo": "if(bucket is not null and lo < hi, greatest(lo, hi - (bucket + 1) * step + 1), lo)",
        "id_lo": "if(bucket is not null and lo = hi, id_lo + bucket * step, id_lo)",
        "id_hi": "if(bucket is not null and lo = hi, least(id_hi, id_lo + (bucket + 1) * step - 1), id_hi)",
        "want": "want - coalesce(taken, 0)",
    }
    return with_step(out.select("anchor", "win", *[F.expr(e).alias(c) for c, e in new.items()], "best", "left"))


def selected(blocks: Blocks, state: DataFrame, same: bool) -> DataFrame:
    """(anchor, win, id, score) of the wanted best rows of each window, and of up to SLACK more."""
    active, done = with_step(state), None
    is_open = F.expr(f"coalesce(left > want + {SLACK} and (lo < hi or id_lo < id_hi), false)")
    while True:
        after = materialize(narrowed(active, blocks.windows(active, same, best_buckets, ("bucket", "n"))), "windows")
        ended = after.filter(~is_open).drop("left")
        done = ended if done is None else done.unionByName(ended)
        active = after.filter(is_open).drop("left")
        if active.isEmpty():
            return blocks.windows(done, same, qualifying, ("id", "score"))


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The first k of each window's rows, which are few by now."""
    order = Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, label: Column | None = None, mining: Mining = Mining(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchors: a condition on `id`; label: a Column in place of label_col."""
    rows = materialize(scaled(rows, mining.scale, id_col, vector_col, F.col(label_col) if label is None else label), "scaled")
    blocks = Blocks(rows, rows.filter(anchors))
    length = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    least, most, longest = rows.agg(F.min("id"), F.max("id"), F.max(length)).first()
    ids = [F.lit(least or 0).cast("long").alias("id_lo"), F.lit(most or 0).cast("long").alias("id_hi")]
    reach = F.lit(int((longest or 0.0)) + 1).cast("long")  # no product exceeds the square of the longest length
    want = lambda n: F.lit(n).cast("long").alias("want")
    state = blocks.anchors.select("anchor", F.lit(0).cast("long").alias("win"), (-reach).alias("lo"), reach.alias("hi"), *ids, want(mining.positives), reach.alias("best"))
    positives = materialize(ranked(selected(blocks, state, True), mining.positives), "positives")
    # of a positive below zero no score is between the two shares
    bounds = positives.filter("score >= 0").withColumns({"lo": F.expr(f"({mining.least} * score + 99) div 100"), "hi": F.expr(f"({mining.most} * score) div 100")}).filter("lo <= hi")
    state = bounds.select("anchor", F.col("id").alias("win"), "lo", "hi", *ids, want(mining.negatives), F.col("hi").alias("best"))
    found = ranked(selected(blocks, state, False), mining.negatives)
    scores = positives.select("anchor", F.col("id").alias("win"), F.col("score").alias("positive_score"))
    return found.join(scores, ["anchor", "win"]).select(F.col("anchor").alias("anchor_id"), F.col("win").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
