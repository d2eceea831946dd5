"""Windows of tokens that occur more than once, found through anchored spans. Shared by suffix and substring dedup.

Every window of `window` tokens has an anchor: the position of the smallest k-gram hash among its first `reach`
positions. Equal windows have equal anchors at equal distances, so windows are compared through the suffixes that
start at anchors, one in about reach / 2 positions. Neighbouring windows of one anchor form a span. All windows of an
anchor share the `window - reach + 1` tokens after it, its core.

1. Spans whose core occurs once are dropped: their windows are unique. (Aggregate over 64-bit hashes.)
2. A span that occurs again as a whole has no unique window. (Aggregate.)
3. Of the rest, one of each is taken with its tokens into buckets by range of its leading tokens, where a matcher
   compares the windows. A core that reaches over the edge of a bucket, as a frequent one may, is compared once more
   across buckets by hashes of its windows, combined before they are shuffled.
4. What is found of a span counts at all its places in the text of the smallest id, not only at the one that was taken.

Texts are identified by a 64-bit hash and their length; equal texts go through once for each task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BIN, INT, LONG, materialize, shuffle_partitions, struct
from .ngram_join import WordHashes, mix

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PLACE_BITS = np.uint64((1 << 28) - 1)
NO_ID = (1 << 63) - 1
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


class Powers:
    """Powers of the hash's base and of its inverse, as many as were needed so far."""

    up = np.empty(0, np.uint64)
    down = np.empty(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            m = max(n, 1 << 20)
            cls.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(m, BASE))])
            cls.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(m, INVERSE))])
        return cls.up, cls.down


class Hashes:
    """Hash of any stretch of a token sequence from sums over its prefixes."""

    def __init__(self, codes: np.ndarray):
        up, self.down = Powers.of(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[: len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Least of each width values in a row, by running minima from both ends of blocks."""
    n = len(v) - width + 1
    padded = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


@dataclass(frozen=True)
class Windows:
    window: int
    reach: int
    gram: int
    codes: Callable[[str | None], np.ndarray]  # token codes of a text

    def spans(self, texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """text index, core, full, start, count, off of each span. start is the first window's, off the anchor's distance from it."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        keep = np.flatnonzero(sizes >= self.window)
        if not len(keep):
            return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
        codes, sizes = np.concatenate([texts[k] for k in keep]), sizes[keep]
        first = np.cumsum(sizes) - sizes
        windows = sizes - self.window + 1
        h = Hashes(codes)
        at = np.arange(len(codes) - self.gram + 1)
        v = (h.of(at, at + self.gram) & ~PLACE_BITS) | at.astype(np.uint64)
        least = sliding_least(v, self.reach)
        owner = np.repeat(np.arange(len(keep)), windows)
        i = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + first[owner]
        anchor = (least[i] & PLACE_BITS).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (i[1:] != i[:-1] + 1)]))
        end = np.concatenate([new[1:], [len(i)]]) - 1
        i0, i1, a, who = i[new], i[end], anchor[new], owner[new]
        core = h.of(a, a + self.window - self.reach + 1)
        full = mix(h.of(i0, i1 + self.window) + (a - i0).astype(np.uint64) * BASE)
        return keep[who], core, full, i0 - first[who], i1 - i0 + 1, a - i0


ROWS = struct(core=LONG, full=LONG, d=LONG, place=LONG)


def span_rows(docs: DataFrame, w: Windows) -> DataFrame:
    """core, full, d (the text's hash) and place: start, count and off in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                ds, codes = [], []
                for d, t in zip(batch.column(0).slice(lo, 200).to_pylist(), batch.column(1).slice(lo, 200).to_pylist(), strict=True):
                    if d not in seen:
                        seen.add(d)
                        ds.append(d), codes.append(w.codes(t))
                if len(seen) > 2_000_000:
                    seen.clear()
                if ds:
                    who, core, full, start, count, off = w.spans(codes)
                    place = (start << 20) | (count << 10) | off
                    yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(full.view(np.int64)), pa.array(np.array(ds, np.int64)[who]), pa.array(place)], names=ROWS.names)

    return docs.select("d", "text").mapInArrow(run, ROWS)


FIRST, LAST = "shiftright(place, 20)", "shiftright(place, 20) + (shiftright(place, 10) & 1023) - 1"

CONTEXT = struct(core=LONG, full=LONG, d=LONG, doc=LONG, start=LONG, count=LONG, off=LONG, known=INT, lead=BIN, tokens=BIN)
#: kind 0: windows first .. last of a text are repeats; kind 1: a band of windows from first on, for comparison across
#: buckets: hash is that of what its windows share, cells are their own, bits of asked tell which are still open.
#: start is that of the span they are in
FOUND = struct(kind=INT, d=LONG, doc=LONG, start=LONG, first=LONG, last=LONG, hash=LONG, asked=LONG, cells=T.ArrayType(LONG))
BAND = 8

#: (frame of one bucket, sorted by lead, core, doc) -> repeat flags of each row's windows
Matcher = Callable[[pd.DataFrame], list[np.ndarray]]


def intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def other_places(spans: DataFrame, several: DataFrame) -> DataFrame:
    """Where a span with something to ask stands again in texts of its smallest id: d, start of the place that is asked about; to, shift of the other."""
    often = several.filter("known = 0 and lo <> hi").select("core", "full", "least")
    places = materialize(spans.join(often, ["core", "full"]).filter("doc = least").select("core", "full", "d", "place"), "places")
    taken = places.groupBy("core", "full").agg(F.min(F.struct("d", "place")).alias("s"), F.count("*").alias("n")).filter("n > 1")
    more = places.join(taken.select("core", "full", "s"), ["core", "full"]).filter("d <> s.d or place <> s.place")
    start = F.expr("shiftright(s.place, 20)")
    return materialize(more.select(F.col("s.d").alias("d"), start.alias("start"), F.col("d").alias("to"), (F.expr("shiftright(place, 20)") - start).alias("shift")), "places")


def repeats(docs: DataFrame, w: Windows, earlier: bool, matcher: Matcher, to_codes: Callable[[bytes], np.ndarray], raw: Callable[[str | None], np.ndarray], part_rows: int = 12_000) -> tuple[DataFrame, DataFrame]:
    """Texts (d, doc, copies) and their spans: (d, spans: array of (first, last) repeated window starts) where there are any.

    docs has doc_id (no nulls), text, and d, the same for equal texts. A window repeats if it occurs elsewhere, or with
    `earlier` if it occurs in a text whose smallest doc_id is smaller. Copies of one text are for the caller.
    raw gives a text's tokens as they are carried, to_codes turns them into codes for hashing.
    """
    texts = materialize(docs.groupBy("d").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies")), "texts")
    rows = span_rows(docs, w)
    occ = F.xxhash64("d", "place")
    again = materialize(rows.groupBy("core").agg(F.min(occ).alias("lo"), F.max(occ).alias("hi")).filter("lo <> hi").select("core"), "cores")
    spans = materialize(rows.join(again, "core").join(texts.select("d", "doc"), "d").withColumn("occ", occ), "spans")

    each = spans.groupBy("core", "full").agg(F.min("occ").alias("lo"), F.max("occ").alias("hi"), F.min("doc").alias("least"))
    each = materialize(each, "kinds")
    cores = materialize(each.groupBy("core").agg(F.count("*").alias("kinds"), F.min("least").alias("least_of_core")), "kinds")
    known = spans.join(each, ["core", "full"])
    whole = known.filter(F.col("doc") > F.col("least") if earlier else F.col("lo") != F.col("hi")).select("d", F.expr(FIRST).alias("first"), F.expr(LAST).alias("last"))

    # of each different span of a core with several, the one in the text of the smallest id; known: nothing is left to ask
    several = each.join(cores.filter("kinds > 1"), "core").withColumn("known", (F.col("least") == F.col("least_of_core") if earlier else F.col("lo") != F.col("hi")).cast("int"))
    one = spans.groupBy("core", "full").agg(F.min(F.struct("doc", "d", "place")).alias("s")).join(several, ["core", "full"])
    asked = one.groupBy(F.col("s.d").alias("d"), F.col("s.doc").alias("doc_id")).agg(F.collect_list(F.struct("core", "full", "s.place", "known")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary() if n in ("lead", "tokens") else pa.int32() if n == "known" else pa.int64() for n in CONTEXT.names]
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                out = []
                for r in batch.slice(lo, 100).to_pylist():
                    tokens = raw(r["text"])
                    for a in r["asked"]:
                        start, count, off = a["place"] >> 20, a["place"] >> 10 & 1023, a["place"] & 1023
                        out.append((a["core"], a["full"], r["d"], r["doc_id"], start, count, off, a["known"], tokens[start + off : start + off + 16].tobytes()[:16], tokens[start : start + count - 1 + w.window].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=CONTEXT.names)

    contexts = materialize(docs.join(asked, ["d", "doc_id"]).select("d", "doc_id", "text", "asked").mapInArrow(cut, CONTEXT), "contexts")
    parts = max(shuffle_partitions(docs.sparkSession), -(-contexts.count() // part_rows))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        if not frames:
            return
        frame = pd.concat(frames).drop_duplicates(["core", "full"]).sort_values(["lead", "core", "doc", "full"], kind="stable").reset_index(drop=True)
        flags, out = matcher(frame), []
        for own, d, start, done in zip(flags, frame["d"], frame["start"], frame["known"], strict=True):
            if not done:
                out += [(0, d, 0, start, start + a, start + b, 0, 0, []) for a, b in intervals(own)]
        # cores at the bucket's edges may go on in the next one
        edge = frame.index[frame["core"].isin([frame["core"].iloc[0], frame["core"].iloc[-1]])]
        met: set[tuple] = set()
        for r in edge:
            row = frame.loc[r]
            h, k = Hashes(to_codes(row["tokens"])), np.arange(row["count"])
            cells = h.of(k, k + w.window).view(np.int64)
            open_ = np.zeros(len(k), bool) if row["known"] else ~flags[r]
            band = (row["off"] - k) // BAND  # bands are counted from the anchor, so they are the same in equal texts
            cut = [0, *(np.flatnonzero(np.diff(band)) + 1).tolist(), len(k)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                own = cells[lo:hi].tolist()
                if not open_[lo:hi].any():  # nothing to ask: one of each is enough to answer others
                    if (key := tuple(own)) in met:
                        continue
                    met.add(key)
                at = np.array([row["off"] - int(band[lo]) * BAND])
                shared = mix(h.of(at, at + w.window - BAND + 1) + band[lo : lo + 1].astype(np.uint64) * BASE)
                out.append((1, row["d"], row["doc"], row["start"], row["start"] + lo, 0, int(shared.view(np.int64)[0]), int((open_[lo:hi] << np.arange(hi - lo)).sum()), own))
        for lo in range(0, len(out), 20_000):
            yield pd.DataFrame(out[lo : lo + 20_000], columns=FOUND.names)

    found = materialize(contexts.repartitionByRange(int(parts), "lead", "core", "full").mapInPandas(match, FOUND), "matches")
    where = F.col("doc") if earlier else F.xxhash64("d", "first")
    edge = found.filter("kind = 1")
    bands = materialize(edge.groupBy("hash").agg(F.min(where).alias("lo"), F.max(where).alias("hi")).filter("lo <> hi").select("hash"), "bands")
    both = edge.join(bands, "hash").select("d", "doc", "start", "first", "asked", F.posexplode("cells").alias("pos", "cell"))
    both = materialize(both.select("d", "doc", "start", "cell", (F.col("first") + F.col("pos")).alias("first"), F.expr("shiftright(asked, pos) & 1").alias("asked")), "windows")
    same = materialize(both.groupBy("cell").agg(F.min(where).alias("lo"), F.max(where).alias("hi")).filter("lo <> hi"), "edges")
    over = both.filter("asked = 1").join(same, "cell").filter(F.col("doc") > F.col("lo") if earlier else F.lit(True))
    hits = found.filter("kind = 0").select("d", "start", "first", "last").unionByName(over.select("d", "start", "first", F.col("first").alias("last")))
    every = whole.unionByName(hits.select("d", "first", "last"))
    if earlier:
        every = every.unionByName(hits.join(other_places(spans, several), ["d", "start"]).select(F.col("to").alias("d"), (F.col("first") + F.col("shift")).alias("first"), (F.col("last") + F.col("shift")).alias("last")))
    return texts, every.groupBy("d").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def with_spans(docs: DataFrame, texts: DataFrame, spans: DataFrame) -> DataFrame:
    """docs (doc_id, text, d) with doc, copies and spans of their text; texts that occur once and have no spans get nulls."""
    per_text = texts.join(spans, "d", "left").filter("copies > 1 or spans is not null")
    per_text = materialize(per_text, "per-text")
    per_row = docs.select("doc_id", "d").dropDuplicates().join(per_text, "d")
    return docs.join(per_row, ["doc_id", "d"], "left")


def keyed(docs: DataFrame, id_col: str, text_col: str, rest: list[str] = ()) -> DataFrame:
    """doc_id, text, d and the columns of rest as one struct; a null id counts as larger than any other, a null text as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    more = [F.struct(*rest).alias("rest")] if rest else []
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), text.alias("text"), F.xxhash64(text, F.octet_length(text)).alias("d"), *more)


def covered(n: int, spans: list, window: int) -> np.ndarray:
    """Which of n tokens lie in a repeated window."""
    delta = np.zeros(n + 1, np.int64)
    for s in spans:
        delta[s["first"]] += 1
        delta[s["last"] + window] -= 1
    return np.cumsum(delta[:n]) > 0


def text_words_kept(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


_hash_of = WordHashes()


def word_codes(text: str | None) -> np.ndarray:
    ws = text_words_kept(text)
    if len(_hash_of) > 200_000:
        _hash_of.clear()
    return np.fromiter(map(_hash_of.__getitem__, ws), np.uint64, len(ws))
