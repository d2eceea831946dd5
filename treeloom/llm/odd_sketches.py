"""Near-duplicate classes by MinHash bands, odd sketches and exact verification.

A document's set is its distinct n-word shingles. Its SAMPLES MinHash values make BANDS bands of ROWS values, which are
the keys that likely pairs meet by: at a likeness of 0.8 a pair misses all of them once in 10^11. The same values are
folded into an odd sketch, a bitmap in which each value flips the bit that its hash names: values that two sets share
cancel, so the population count of the XOR of two sketches tells how many they do not share. Candidates go on only if
that count is one that a pair at the bound exceeds less than once in 10^9; they are then confirmed on their full sets.

Equal sets are one node. Links are wanted only as components, so nodes first meet one hub of their bands in each of some
rounds, and only bands whose nodes lie in different components go on. What is left is joined band by band for nodes
that meet few others. Nodes that meet many which are not linked to them, as texts with one long passage do, are joined
through the rare tokens of their sets instead (ngram_join), an exact way without a cap on buckets.

Null, empty and blank texts have empty sets, linked with nothing. Very long texts are cut whole. Repeated rows are one
node; rows that share an id but not a text are judged each by its own text. A null id takes part; its component is the
smallest id that it reaches, or null. Other columns are ignored, whatever their names; an empty table gives an empty
result. Ties of likeness at the bound count as links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ngram_join
from .common import LONG, materialize, struct
from .components import components
from .ngram_join import Likeness, distinct, mix, node_of, placed_in, shingles_of

ROWS, BANDS = 4, 48
SAMPLES = ROWS * BANDS
WORDS64 = 8
BITS = 64 * WORDS64
ROUNDS = 5
FEW = 48
SKETCH = [f"s{i}" for i in range(WORDS64)]
SKETCHES = T.StructType([*struct(doc_id=LONG, d=LONG, n=LONG, node=LONG, bands=T.ArrayType(LONG)), *[T.StructField(s, LONG) for s in SKETCH]])

_seeds = mix(np.arange(1, 3 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTORS, SHIFTS, SALTS = _seeds[:SAMPLES] | np.uint64(1), _seeds[SAMPLES : 2 * SAMPLES], _seeds[2 * SAMPLES :]


def min_hashes(tokens: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over a set."""
    out = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(tokens), 4096):
        np.minimum(out, (FACTORS[:, None] * tokens[None, lo : lo + 4096] + SHIFTS[:, None]).min(axis=1), out=out)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band; other bands have other keys."""
    out = SALTS[:BANDS].copy()
    for column in values.reshape(BANDS, ROWS).T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """BITS bits as signed 64-bit words: the parity of how many values fall on each."""
    at = (mix(values ^ SALTS) >> np.uint64(32)) % np.uint64(BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8), bitorder="little").view(np.int64)


@lru_cache
def most_odd_bits(percent: int, missed: float = 1e-9) -> int:
    """Bits that the sketches of two sets at the bound differ in at most, but for a share `missed` of the pairs.

    A value that is not shared flips two bits, anywhere; the number of such values is binomial.
    """
    share, odd = 1 - percent / 100, np.zeros(BITS + 1)
    odd[0] = 1.0
    j, total, weight = np.arange(BITS + 1), np.zeros(BITS + 1), (1 - share) ** SAMPLES
    for differing in range(SAMPLES + 1):
        total += weight * odd
        weight *= (SAMPLES - differing) / (differing + 1) * share / (1 - share) if share < 1 else 0.0
        for _ in range(2):
            up, down = odd * (BITS - j) / BITS, odd * j / BITS
            odd = np.concatenate([[0], up[:-1]]) + np.concatenate([down[1:], [0]])
    tail = 1 - np.cumsum(total)
    return int(np.flatnonzero(tail <= missed)[0])


def sketches(docs: DataFrame, like: Likeness) -> DataFrame:
    """SKETCHES of docs (doc_id, d, text); a set that a task has met before has no bands and no sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part, rows = batch.slice(lo, 500), []
                for s in map(distinct, shingles_of(part.column(2).to_pylist(), like.words)):
                    node = node_of(s) if len(s) else None
                    if node is None or node in met:
                        rows.append((len(s), node, None, *[None] * WORDS64))
                        continue
                    met.add(node)
                    values = min_hashes(s)
                    rows.append((len(s), node, band_keys(values).view(np.int64), *odd_sketch(values).tolist()))
                if len(met) > 1_000_000:
                    met.clear()
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.int64()] * WORDS64]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], names=SKETCHES.names)

    return docs.select("doc_id", "d", "text").mapInArrow(run, SKETCHES)


def likely(pairs: DataFrame, one: DataFrame, like: Likeness) -> DataFrame:
    """Of pairs (a, b) those whose sizes and odd sketches allow the likeness."""
    a, b = (one.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), *[F.col(s).alias(f"{s}_{x}") for s in SKETCH]) for x in "ab")
    odd = sum((F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in SKETCH[1:]), F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))))
    both = pairs.join(a, "a").join(b, "b").filter(ngram_join.can_be_alike("n_a", "n_b", like))
    return both.filter(odd <= most_odd_bits(like.percent)).select("a", "b")


def met_hubs(docs: DataFrame, found: DataFrame, one: DataFrame, like: Likeness, group: DataFrame | None = None, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Bands (token, node) whose nodes are still apart, the components and the verified edges, after rounds of one hub a node.

    group, edges: those so far.
    """
    for r in range(ROUNDS):
        placed = placed_in(found, group)
        hubs = placed.groupBy("token").agg(F.min_by("node", F.xxhash64("node", F.lit(r))).alias("hub"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
        found = materialize(found.select("token", "node").join(hubs.select("token", "hub"), "token").distinct(), "bands")
        near = placed_in(found, group).filter("node <> hub").groupBy("node", "component", "hub").agg(F.count("*").alias("c"))
        if group is not None:
            near = near.join(group.select(F.col("id").alias("hub"), F.col("component").alias("at")), "hub", "left").filter("component <> coalesce(at, hub)")
        star = near.groupBy("node").agg(F.max_by("hub", F.struct("c", "hub")).alias("a")).select("a", F.col("node").alias("b"))
        star = materialize(likely(star, one, like), "star")
        if star.isEmpty():
            break
        got = ngram_join.checked(docs, star, one, like)
        edges = got if edges is None else edges.unionByName(got)
        group = components(edges)
        if 10 * got.count() <= star.count():
            break
    return found.select("token", "node"), group, edges


def apart(found: DataFrame, group: DataFrame | None) -> DataFrame:
    """(token, node, component, few): bands whose nodes are still apart; few: whether a node meets at most FEW others in all of them."""
    placed = placed_in(found, group).select("token", "node", "component")
    often = placed.groupBy("token").agg(F.count("*").alias("times"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    rows = materialize(placed.join(often.select("token", "times"), "token"), "apart")
    cost = rows.groupBy("node").agg((F.sum(F.col("times") - 1) <= FEW).alias("few"))
    return materialize(rows.select("token", "node", "component").join(cost, "node"), "rest")


def left_pairs(docs: DataFrame, rest: DataFrame, group: DataFrame | None, edges: DataFrame | None, one: DataFrame, like: Likeness) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(a, b) of nodes in different components that may be alike, and components and edges so far.

    Near copies of one text that are alike in small groups only meet a hub of the same rare difference first.
    """
    x, y = (rest.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "component", "few")]) for s in "ab")
    few = x.filter("few_a").join(y, "token").filter("component_a <> component_b and (not few_b or node_a < node_b)")
    pairs = few.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    many = rest.filter("not few").select("node").distinct()
    if not many.isEmpty():
        hot = ngram_join.hot_cells(ngram_join.texts_of(docs, many, one), like)
        if group is None:
            group = one.select(F.col("node").alias("id"), F.col("node").alias("component"))

        def settle(tokens: DataFrame) -> DataFrame:
            nonlocal group, edges
            _, group, edges = met_hubs(docs, tokens, one, like, group, edges)
            return group

        pairs = pairs.unionByName(ngram_join.many_candidates(docs, rest, group, one, like, hot, settle))
    return materialize(likely(pairs, one, like), "pairs"), group, edges


def classes(docs: DataFrame, like: Likeness = Likeness(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row, whether it is the one that stays, and text_hash, which with the id tells rows of one id apart."""
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("d"), text.alias("text"))
    rows = materialize(sketches(docs, like), "sketches")
    one = materialize(ngram_join.stand_ins(rows, [F.first(s, ignorenulls=True).alias(s) for s in SKETCH]), "nodes")
    found = rows.filter("bands is not null").select("node", F.explode("bands").alias("token"))
    found, group, edges = met_hubs(docs, found, one, like)
    pairs, group, edges = left_pairs(docs, apart(found, group), group, edges, one, like)
    more = ngram_join.checked(docs, pairs, one, like)
    if not more.isEmpty():
        group = components(ngram_join.with_links(more, group, edges))
    out = ngram_join.labelled(rows, one, group)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
