"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct n-word shingles (64-bit hashes). Tokens have one global order: by estimated frequency,
then by hash. Two sets of likeness t or more share at least l tokens among the first |x| - ceil(t|x|) + l of each.
Every document picks its own l: a longer prefix makes more lookups, but only documents that share min(l, l') prefix
tokens are verified, so l grows with the estimated number of candidates. Frequencies come from hashed counters over
all documents; they steer cost only, never results.

Equal sets are one node, named by a 64-bit hash of the set. The join returns the components of the links between
nodes, in three steps, each of which looks only at tokens whose nodes lie in different components so far:

1. Rounds in which every node is verified against one other, the hub of most of its prefix tokens; hubs change from
   round to round. They end when few of the pairs are alike. A large group of near copies costs a verification a
   member and round rather than one a pair.
2. Nodes with few candidates, as the tokens' exact counts now tell, are joined with all that share enough tokens. All
   tokens up to the end of the prefix that ends first are known, so those of them that are not shared bound a pair.
3. The other nodes get a longer prefix, about twice the first, of which a partner shares at least l tokens, l about a
   half. So each may leave out the l - 1 tokens that most nodes have, by exact count, and still meets every partner
   in one of the rest: a passage that many documents share makes no candidates by itself. Near copies of one text
   that are not alike among themselves share nearly all tokens; so nodes with one hub meet by the tokens in which they
   differ from it, of which alike nodes share nearly all, the rarest ones included.

So no link that matters is lost. For verification compressed texts travel, which are a third of the sets' size; they
are cut into sets again where both meet.

Null, empty and blank texts have empty sets, linked with nothing. Very long texts are cut whole. Repeated rows are one
node; rows that share an id but not a text are judged each by its own text. A null id takes part as well; its
component is the smallest id that it reaches, or null. Other columns are ignored, whatever their names; an empty
table gives an empty result. Ties of likeness at the bound count as links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BIN, INT, LONG, materialize, struct
from .components import components

MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
LONGEST_MATCH = 4
HOT_CELLS = 100_000
ROUNDS = 6
FEW = 32
CELL_BITS = 22
ROWS_A_PART = 1_000_000


@dataclass(frozen=True)
class Likeness:
    words: int = 5
    percent: int = 80

    def least(self, n: int) -> int:
        """Fewest shared tokens of a set of n with any like set."""
        return -(-self.percent * n // 100)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words, remembered; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


#: Codes of bytes, the same for A-Z as for a-z; and which bytes separate words.
BASE = 0x9E3779B97F4A7C15
_letters = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
BYTE_CODES = mix((_letters + np.uint64(1)) * np.uint64(BASE))
SEPARATES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """At least n powers of the base, and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, 1 << 17)
        _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(m, np.uint64(pow(BASE, e, 1 << 64))))]) for e in (1, -1)]
    return _powers


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start, and their 64-bit hashes, A-Z as a-z: differences of one running sum over its bytes."""
    b = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], ~SEPARATES[b], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(BYTE_CODES[b] * up[: len(b)], out=sums[1:])
    return start, mix((sums[end] - sums[start]) * down[start])


def windows(h: np.ndarray, words: int) -> np.ndarray:
    """Hashes of the windows of so many words."""
    n = len(h) - words + 1
    out = np.full(n, words, dtype=np.uint64)
    for k in range(words):
        out = mix(out * np.uint64(BASE) + h[k : k + n])
    return out


def utf8(text: str | bytes | None) -> bytes:
    return text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")


def shingle_hashes(text: str | bytes | None, words: int) -> np.ndarray:
    """64-bit hashes of a text's shingles, in order; one of the whole sequence if it has fewer words."""
    h = words_of(utf8(text))[1]
    return windows(h, min(words, len(h))) if len(h) else h


#: Bytes of texts that are hashed at once: few calls, and arrays that stay in the processor's cache.
STRETCH = 1 << 17


def shingles_of(texts: Iterable[str | bytes | None], words: int) -> Iterator[np.ndarray]:
    """shingle_hashes of each text, short ones many at a time."""
    own: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        start, h = words_of(b"\n".join(own))
        ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in own]))
        whole = windows(h, words) if len(h) >= words else h[:0]
        for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            yield whole[lo : hi - words + 1] if hi - lo >= words else windows(h[lo:hi], hi - lo) if hi > lo else h[:0]

    for text in texts:
        own.append(utf8(text))
        size += len(own[-1])
        if size >= STRETCH:
            yield from flush()
            own, size = [], 0
    if own:
        yield from flush()


def distinct(out: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    out = np.sort(out)
    return out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) else out


def shingle_set(text: str | bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes."""
    return distinct(shingle_hashes(text, words))


def hot_cells(docs: DataFrame, like: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent cells of the tokens' hash range, and in how many texts they are, about; at most HOT_CELLS.

    Every task counts all tokens of its texts in 2^CELL_BITS cells and reports those well above the mean.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << CELL_BITS, np.int32), set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                fresh = []
                for text in batch.column(0).slice(lo, 1000).to_pylist():
                    digest = xxhash.xxh3_64_intdigest(text or "")
                    if digest not in seen:
                        seen.add(digest)
                        fresh.append(text)
                if len(seen) > 1_000_000:
                    seen.clear()
                for h in shingles_of(fresh, like.words):
                    np.add.at(counts, (h >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
        mean = counts.mean()
        cells = np.flatnonzero(counts > mean + 4 * np.sqrt(mean) + 2)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array((counts[cells] - mean).astype(np.int64))], names=["cell", "n"])

    rows = docs.select("text").mapInArrow(run, struct(cell=LONG, n=LONG)).groupBy("cell").agg(F.sum("n").alias("n"))
    top = rows.filter("n >= 4").orderBy(F.desc("n"), "cell").limit(HOT_CELLS).toPandas()
    order = np.argsort(top["cell"].to_numpy(np.int64))
    return top["cell"].to_numpy(np.int64)[order], top["n"].to_numpy(np.int64)[order]


def prefix(tokens: np.ndarray, seen: np.ndarray, like: Likeness) -> tuple[np.ndarray, int]:
    """Places of the tokens that a set is looked up by, and how many of them a partner must share. seen: their frequencies."""
    n = len(tokens)
    order = np.argsort(seen, kind="stable")  # tokens come sorted, so ties are in order of their hash
    base = n - like.least(n)
    best, cost = 1, None
    for match in range(1, LONGEST_MATCH + 1):
        if base + match > n:
            break
        found = float((seen[order[: base + match]] - 1).sum(dtype=np.int64))
        now = found + 20 * found / match
        if cost is None or now < cost:
            best, cost = match, now
    return order[: min(n, base + best)], best


#: d: hash of the text; node: hash of the set; l, p: shared tokens asked for, length of the prefix; end, last: frequency
#: and hash of its last token; parts: into how many parts a frequent token's rows are split
SETS = struct(doc_id=LONG, d=LONG, n=LONG, node=LONG, l=INT, p=INT, end=LONG, last=LONG, prefix=T.ArrayType(LONG), parts=T.ArrayType(INT))


def node_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def prefixes(docs: DataFrame, like: Likeness, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """A row for each of docs; the prefix of a set that a task has met before is left out."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # at most HOT_CELLS entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, counts = shared.value
        frequency = np.ones(1 << CELL_BITS, np.int32)
        frequency[cells] = np.minimum(counts, 2**31 - 1)
        met: set[int] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ns, nodes, ls, firsts, parts = [], [], [], [], []
                for s in map(distinct, shingles_of(part.column(2).to_pylist(), like.words)):
                    node = node_of(s) if len(s) else None
                    p, match = np.empty(0, np.int64), 0
                    if len(s):
                        seen = frequency[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                        p, match = prefix(s, seen, like)
                    if len(p) and node not in met:
                        met.add(node)
                        firsts.append(s[p].view(np.int64)), parts.append(1 + seen[p].astype(np.int64) // ROWS_A_PART)
                    else:
                        firsts.append(np.empty(0, np.int64)), parts.append(np.empty(0, np.int64))
                    ns.append(len(s)), nodes.append(node), ls.append((match, len(p), int(seen[p[-1]]), int(s[p[-1]]) - (1 << 63)) if len(p) else (0, 0, 0, 0))
                if len(met) > 1_000_000:
                    met.clear()
                ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in firsts])]).astype(np.int32))
                flat, often = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(firsts))), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts).astype(np.int32)))
                columns = [part.column(0), part.column(1), pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.array([x[0] for x in ls], pa.int32()), pa.array([x[1] for x in ls], pa.int32()), pa.array([x[2] for x in ls], pa.int64()), pa.array([x[3] for x in ls], pa.int64()), flat, often]
                yield pa.RecordBatch.from_arrays(columns, names=SETS.names)

    return docs.select("doc_id", "d", "text").mapInArrow(run, SETS)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def alike(pairs: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """Of pairs (a, b) of nodes, those whose sets are alike. texts has (node, z): one compressed text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, sets, held = zstandard.ZstdDecompressor(), {}, 0

        def set_of(node: int, z: bytes) -> np.ndarray:
            nonlocal held
            got = sets.get(node)
            if got is None:
                if held > 1_000_000:
                    sets.clear()
                    held = 0
                got = sets[node] = shingle_set(unpack.decompress(z), like.words)
                held += len(got)
            return got

        for batch in batches:
            keep = []
            for i, (a, b, x, y) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                mine, other = set_of(a, x), set_of(b, y)
                both = common(mine, other)
                if 100 * both >= like.percent * (len(mine) + len(other) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    x = texts.select(F.col("node").alias("a"), F.col("z").alias("x"))
    y = texts.select(F.col("node").alias("b"), F.col("z").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(run, struct(a=LONG, b=LONG))


def texts_of(docs: DataFrame, nodes: DataFrame, one: DataFrame) -> DataFrame:
    """(node, text) of the rows that stand for nodes; one a node, but for repeated rows."""
    wanted = one.join(nodes, "node").select("node", F.col("doc_id").alias("id"), F.col("d").alias("h"))
    return docs.join(wanted, docs.doc_id.eqNullSafe(F.col("id")) & (docs.d == F.col("h"))).select("node", "text")


def packed_texts(docs: DataFrame, nodes: DataFrame, one: DataFrame) -> DataFrame:
    """(node, z) of nodes: the text of the row that stands for each, compressed before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                z = [pack.compress(t.encode("utf-8", "surrogatepass")) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(z, pa.binary())], names=["node", "z"])

    return texts_of(docs, nodes, one).mapInArrow(run, struct(node=LONG, z=BIN)).dropDuplicates(["node"])


def checked(docs: DataFrame, pairs: DataFrame, one: DataFrame, like: Likeness) -> DataFrame:
    """The alike ones of pairs, a table; only documents in a pair are read again."""
    if pairs.isEmpty():
        return pairs
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    return materialize(alike(pairs, packed_texts(docs, nodes, one), like), "edges")


def shared_tokens(rows: DataFrame) -> DataFrame:
    """(token, node, at, hub) of the prefix tokens that several nodes have. at: its place in the prefix; hub: its first node, of its part.

    One shuffle and sort by token, then a running window that holds one row; the parts of a frequent token are linked
    by their hubs.
    """
    one = rows.filter("size(prefix) > 0").select("node", F.posexplode(F.arrays_zip("prefix", "parts")).alias("at", "t"))
    tokens = one.select(F.col("t.prefix").alias("token"), F.when(F.col("t.parts") > 1, F.pmod("node", "t.parts")).otherwise(0).cast("int").alias("part"), (F.col("t.parts") > 1).alias("split"), "node", "at")

    def first_of(df: DataFrame, *key: str) -> DataFrame:
        w = Window.partitionBy(*key).orderBy("node")
        df = df.withColumn("before", F.lag("node").over(w)).filter("before is null or before <> node")
        return df.select("*", F.first("node").over(w).alias("hub"), F.lead("node").over(w).alias("after"))

    marked = first_of(tokens, "token", "part").withColumn("single", F.expr("node = hub and after is null"))
    found = materialize(marked.filter("split or not single").select("token", "node", "at", "hub", "split", (F.col("node") == F.col("hub")).alias("heads")), "found")
    heads = first_of(found.filter("split and heads").select("token", "node", "at"), "token").filter("node <> hub or after is not null").select("token", "node", "at", "hub")
    return found.select("token", "node", "at", "hub").unionByName(heads)


def can_be_alike(a: str, b: str, like: Likeness) -> F.Column:
    return 100 * F.least(a, b) >= like.percent * F.greatest(a, b)


def placed_in(found: DataFrame, group: DataFrame | None) -> DataFrame:
    """Rows of found with their node's component so far."""
    if group is None:
        return found.withColumn("component", F.col("node"))
    return found.join(group.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))


def joined(docs: DataFrame, found: DataFrame, one: DataFrame, like: Likeness) -> tuple[DataFrame, DataFrame]:
    """Components and verified edges after rounds of looking at one hub a node."""
    group, edges = None, None
    # the hub of a token is a node few of whose tokens are its own, as the original of many copies is
    shared = found.groupBy("node").agg(F.count("*").alias("c")).join(one.select("node", "p"), "node").select("node", (-F.floor(20 * F.col("c") / F.col("p"))).alias("own"))
    found = materialize(found.select("token", "node").join(shared, "node"), "hubs")
    of_hub = one.select(F.col("node").alias("hub"), F.col("n").alias("n_hub"))
    for r in range(ROUNDS):
        placed = placed_in(found, group)
        if group is not None:
            placed = materialize(placed, "placed")
        hub = F.min_by(F.struct("node", "component"), F.struct("own", F.xxhash64("node", F.lit(r))))
        hubs = placed.groupBy("token").agg(hub.alias("h"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
        near = placed.join(hubs.select("token", "h"), "token").filter("component <> h.component").groupBy("node", F.col("h.node").alias("hub")).agg(F.count("*").alias("c"))
        best = near.groupBy("node").agg(F.max_by("hub", F.struct("c", "hub")).alias("hub"), F.max("c").alias("c"))
        # a hub with a third of the prefix's tokens is worth a look now
        star = best.join(one.select("node", "n", "p"), "node").filter("3 * c >= p").join(of_hub, "hub").filter(can_be_alike("n", "n_hub", like))
        star = materialize(star.select(F.col("hub").alias("a"), F.col("node").alias("b")), "star")
        got = checked(docs, star, one, like)
        edges = got if edges is None else edges.unionByName(got)
        group = components(edges)
        if 10 * got.count() <= star.count():
            break
    return group, edges


def counted(found: DataFrame, group: DataFrame, one: DataFrame) -> DataFrame:
    """Rows of tokens with nodes of several components; few: whether their node meets at most FEW others in them."""
    placed = materialize(placed_in(found, group).select("token", "node", "at", "component"), "placed")
    often = placed.groupBy("token").agg(F.count("*").alias("times"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    rows = materialize(placed.join(often.select("token", "times"), "token").dropDuplicates(["token", "node"]), "apart")
    cost = rows.groupBy("node").agg((F.sum(F.col("times") - 1) <= FEW).alias("few"))
    return materialize(rows.join(cost, "node").join(one.select("node", "n", "l", "p", "end"), "node"), "rest")


def few_candidates(rest: DataFrame, like: Likeness) -> DataFrame:
    """(a, b): pairs of which one has few candidates, that can still be alike by the tokens they share."""
    own = ("node", "at", "n", "l", "p", "end", "component", "few")
    x, y = (rest.select("token", *[F.col(c).alias(f"{c}_{s}") for c in own]) for s in "ab")
    pairs = x.filter("few_a").join(y, "token").filter("component_a <> component_b and (not few_b or node_a < node_b)").filter(can_be_alike("n_a", "n_b", like))
    # of a's and b's tokens up to the end of the first of the two prefixes c are shared, the others are not
    passed = [F.when(F.col(f"end_{s}") <= F.col(f"end_{t}"), F.col(f"p_{s}")).otherwise(F.col(f"at_{s}") + 1) for s, t in ("ab", "ba")]
    left = [F.min(F.col(f"n_{s}") - k).alias(f"left_{s}") for s, k in zip("ab", passed, strict=True)]
    pairs = pairs.groupBy("node_a", "node_b", "n_a", "n_b").agg(F.count("*").alias("c"), F.first(F.least("l_a", "l_b")).alias("l"), *left)
    most = F.col("c") + F.least("left_a", "left_b")
    pairs = pairs.filter("c >= l").filter((100 + like.percent) * most >= like.percent * (F.col("n_a") + F.col("n_b")))
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


#: size: class of set sizes, such that sets that can be alike are in one class or in neighbouring ones; k, k_less: the
#: shared tokens that a pair has at least whose smaller set is in this class, in the one before
LONGER = struct(node=LONG, n=LONG, size=INT, k=INT, k_less=INT, prefix=T.ArrayType(LONG), parts=T.ArrayType(INT))


def longer_prefixes(texts: DataFrame, like: Likeness, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(hot)
    ratio = math.log(100 / like.percent * (1 + 1e-6))

    def match_of(size: int) -> int:
        n = math.ceil(math.exp(size * ratio) - 1e-9)
        return max(1, n - like.least(n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, counts = shared.value
        frequency = np.ones(1 << CELL_BITS, np.int32)
        frequency[cells] = np.minimum(counts, 2**31 - 1)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                out = []
                nodes, texts = (c.to_pylist() for c in batch.slice(lo, 500).columns)
                for node, s in zip(nodes, map(distinct, shingles_of(texts, like.words)), strict=True):
                    seen = frequency[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                    size = math.floor(math.log(len(s)) / ratio + 1e-12)
                    k = match_of(size)
                    p = np.argsort(seen, kind="stable")[: len(s) - like.least(len(s)) + k]
                    out.append((node, len(s), size, k, min(k, match_of(size - 1)), s[p].view(np.int64).tolist(), (1 + seen[p] // ROWS_A_PART).tolist()))
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=LONGER.names)

    return texts.mapInArrow(run, LONGER)


def hubs_of(kept: DataFrame) -> DataFrame:
    """(node, hub): of the hubs of its tokens one that many nodes have, so that near copies of one text have the same."""
    hubs = kept.groupBy("token").agg(F.min_by("node", F.xxhash64("node")).alias("hub"))
    near = materialize(kept.select("token", "node").join(hubs, "token").groupBy("node", "hub").agg(F.count("*").alias("c")), "near")
    members = near.groupBy("hub").agg(F.count("*").alias("members"))
    most = F.max("c").over(Window.partitionBy("node"))
    likely = near.join(members, "hub").withColumn("most", most).filter("3 * c >= most")
    return likely.groupBy("node").agg(F.max_by("hub", F.struct("members", "hub")).alias("hub"))


#: tokens: those that only one of node and hub has
DIFFERENCES = struct(hub=LONG, node=LONG, n=LONG, n_hub=LONG, tokens=T.ArrayType(LONG))


def differences(near: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """DIFFERENCES of the rows (node, hub) of near whose sets differ by no more tokens than the node has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, last, h = zstandard.ZstdDecompressor(), None, np.empty(0, np.uint64)
        for batch in batches:
            out = []
            hubs, nodes, xs, ys = (c.to_pylist() for c in batch.columns)
            for hub, node, x, s in zip(hubs, nodes, xs, map(distinct, shingles_of(map(unpack.decompress, ys), like.words)), strict=True):
                if hub != last:
                    last, h = hub, shingle_set(unpack.decompress(x), like.words)
                d = np.setxor1d(h, s, assume_unique=True)
                if len(d) <= len(s):
                    out.append((hub, node, len(s), len(h), d.view(np.int64)))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=DIFFERENCES.names)

    x = texts.select(F.col("node").alias("hub"), F.col("z").alias("x"))
    y = texts.select("node", F.col("z").alias("y"))
    return near.join(y, "node").join(x, "hub").select("hub", "node", "x", "y").mapInArrow(run, DIFFERENCES)


#: Merges the components of nodes that share one of a table's tokens and are alike: (token, node) to (id, component).
Settle = Callable[[DataFrame], DataFrame]


def around_hubs(found: DataFrame, group: DataFrame, like: Likeness, settle: Settle | None = None) -> DataFrame:
    """(a, b): pairs of a hub and a node alike to it, and pairs of one hub's nodes that can be alike by their differences.

    settle: looks at the nodes that share a rare difference first; then only pairs of different components are left.

    Two sets differ by as many tokens as their differences to a third do. If no token of the differences is shared,
    alike nodes are both alike to the hub, so both have that link. Otherwise the first shared token, the rarest ones
    of a hub coming first, tells that all before it are not shared.
    """
    bound = lambda s, n: (100 + like.percent) * s <= (100 - like.percent) * n
    c = F.col
    rows = placed_in(found.withColumn("r", F.size("tokens").cast("long")), group).withColumn("linked", bound(c("r"), c("n") + c("n_hub")))
    links = rows.filter("linked").select(c("hub").alias("a"), c("node").alias("b"))
    tokens = materialize(rows.select("hub", F.explode("tokens").alias("token"), "node", "n", "r", "component", "linked"), "differences")
    times = tokens.groupBy("hub", "token").agg(F.count("*").alias("times"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("times", "token")) - 1
    first = tokens.join(times, ["hub", "token"]).withColumn("at", place)
    first = materialize(first.filter("times > 1").filter(bound(like.percent * c("at"), (100 + like.percent) * c("n"))), "first")
    if settle is not None:
        group = settle(first.select(F.xxhash64("hub", "token").alias("token"), "node"))
        first = materialize(placed_in(first.drop("component"), group), "first")
    own = ("node", "n", "r", "at", "component", "linked")
    x, y = (first.select("hub", "token", *[c(k).alias(f"{k}_{s}") for k in own]) for s in "ab")
    differ = c("at_a") + c("at_b") + F.abs(c("r_a") - c("at_a") - c("r_b") + c("at_b"))
    pairs = x.join(y, ["hub", "token"]).filter("node_a < node_b and component_a <> component_b and not (linked_a and linked_b)").filter(bound(differ, c("n_a") + c("n_b")))
    return links.unionByName(pairs.select(c("node_a").alias("a"), c("node_b").alias("b")).distinct())


def many_candidates(docs: DataFrame, rest: DataFrame, group: DataFrame, one: DataFrame, like: Likeness, hot: tuple[np.ndarray, np.ndarray], settle: Settle | None = None) -> DataFrame:
    """(a, b): pairs of nodes with many candidates each that share one of the tokens that their longer prefixes keep.

    Pairs of nodes with the same hub are found by what they do not share with it instead.
    """
    nodes = rest.filter("not few").select("node").distinct()
    rows = materialize(longer_prefixes(texts_of(docs, nodes, one), like, hot), "longer")
    found = shared_tokens(rows).select("token", "node").distinct()
    times = found.groupBy("token").agg(F.count("*").alias("times"))
    ranked = found.join(times, "token").withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("times"), F.desc("token"))))
    sizes = rows.select("node", "n", "size", "k", "k_less").dropDuplicates(["node"])
    kept = materialize(placed_in(ranked.join(sizes, "node").filter("rank >= k_less"), group), "kept")
    near = materialize(hubs_of(kept).filter("node <> hub"), "hubs")
    ends = near.select("node").unionByName(near.select(F.col("hub").alias("node"))).distinct()
    apart = materialize(differences(near, packed_texts(docs, ends, one), like), "apart")
    kept = kept.join(apart.select("node", "hub"), "node", "left").withColumn("hub", F.coalesce("hub", "node"))
    own = ("node", "n", "size", "component", "hub")
    x = kept.filter("rank >= k").select("token", F.col("size").alias("at"), *[F.col(c).alias(f"{c}_a") for c in own])
    at = F.when(F.col("rank") >= F.col("k"), F.array("size", F.col("size") - 1)).otherwise(F.array(F.col("size") - 1))
    y = kept.select("token", F.explode(at).alias("at"), *[F.col(c).alias(f"{c}_b") for c in own])
    pairs = x.join(y, ["token", "at"]).filter("hub_a <> hub_b and component_a <> component_b and (size_a <> size_b or node_a < node_b)").filter(can_be_alike("n_a", "n_b", like))
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct().unionByName(around_hubs(apart, group, like, settle))


def stand_ins(rows: DataFrame, own: list[F.Column]) -> DataFrame:
    """(node, doc_id, d, n, ...) of each node: the row of the smallest id that stands for it, and columns that all its rows agree in."""
    by_id = F.struct(F.col("doc_id").isNull(), "doc_id", "d")
    best = rows.filter("n > 0").groupBy("node").agg(F.min(by_id).alias("s"), F.first("n").alias("n"), *own)
    return best.withColumns({"doc_id": F.col("s.doc_id"), "d": F.col("s.d")}).drop("s")


def with_links(more: DataFrame, group: DataFrame | None, edges: DataFrame | None) -> DataFrame:
    """Edges so far and links between the components so far, which stand for their nodes: many links between two of them are one."""
    if group is None or edges is None:
        return more
    at = group.select("id", "component")
    ends = more.join(at.select(F.col("id").alias("a"), F.col("component").alias("x")), "a", "left").join(at.select(F.col("id").alias("b"), F.col("component").alias("y")), "b", "left")
    between = ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).distinct()
    return edges.unionByName(between)


def labelled(rows: DataFrame, one: DataFrame, group: DataFrame | None) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash of all rows, and whether a row leads its component."""
    label = placed_in(one.select("node", "doc_id"), group).select("node", "doc_id", "component")
    label = materialize(label, "classes")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    least = label.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min(first).alias("s"))
    label = label.join(least, "component").select("node", "component_id", F.col("s.doc_id").alias("lead_id"), F.col("s.node").alias("lead"))
    label = label.join(one.select(F.col("node").alias("lead"), F.col("d").alias("lead_d")), "lead")
    out = rows.select("doc_id", "d", "n", "node").join(label, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    leads = (F.col("n") == 0) | (F.col("doc_id").eqNullSafe(F.col("lead_id")) & (F.col("d") == F.col("lead_d")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("d").alias("text_hash"), leads.alias("leads"))


def classes(docs: DataFrame, like: Likeness = Likeness(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row, and text_hash, which with the id tells rows of one id apart."""
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("d"), text.alias("text"))
    hot = hot_cells(docs, like)
    rows = materialize(prefixes(docs, like, hot), "prefixes")
    own = [F.first("l").alias("l"), F.first("p").alias("p"), F.first(F.struct("end", "last")).alias("end")]
    one = materialize(stand_ins(rows, own), "nodes")
    found = shared_tokens(rows)
    group, edges = joined(docs, found, one, like)
    rest = counted(found, group, one)
    pairs = few_candidates(rest, like).unionByName(many_candidates(docs, rest, group, one, like, hot))
    more = checked(docs, materialize(pairs, "pairs"), one, like)
    if not more.isEmpty():
        group = components(with_links(more, group, edges))
    return labelled(rows, one, group)


def one_of_each(docs: DataFrame, like: Likeness = Likeness(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, unchanged, but of each component only the one of the smallest id (null ids come last).

    Of rows with equal id and text one stays. Rows without words are linked with nothing and all stay.
    """
    row = F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("d"))
    got = classes(docs, like, id_col, text_col).filter("n_shingles > 0").groupBy("doc_id", "text_hash", "leads").agg(F.count("*").alias("times"))
    marks = materialize(got.filter("not leads or times > 1").select(F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("d")).alias("row"), "leads"), "marks")
    key = "__row"
    keyed = docs.withColumn(key, row)
    gone = marks.select(F.col("row").alias(key))
    out = keyed.join(gone, key, "left_anti")
    again = marks.filter("leads").select(F.col("row").alias(key))
    if not again.isEmpty():
        out = out.unionByName(keyed.join(again, key, "left_semi").dropDuplicates([key]))
    return out.select(docs.columns)
