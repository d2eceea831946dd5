"""Phrase collocations: word-id suffix arrays per shard, LCP intervals as n-gram counts, merged over all shards by key.

Texts are cut into words once and kept as shards, a table: the words of one language as ids of the shard's own
vocabulary, pieces apart. Phrases are then counted length by length. A shard's suffixes are sorted by prefix doubling,
as deep as the length asks for; neighbours that share that many words form one interval, its width the count. A phrase
of m words is counted only where both phrases of m - 1 words in it are frequent, as no other can be; tasks know those
from a bitmap of fixed size, whose false hits cost rows but change no count. Counts of all shards meet by
(language, phrase), exact strings.

Null text counts as empty, null languages as `und`. Very long texts are taken whole; a
shard ends with the text that fills it. Repeated rows count each time. Ties of score and count go by phrase, in order of bytes. Columns
other than text and language are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH, BIN, LONG, STR, materialize, shuffle_partitions, struct
from .ngram_join import mix
from .repeats import BYTE_CODES, Hashes

#: Ends of pieces become one word that no text holds, since all its bytes are ends of pieces themselves.
END = b"."
ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", END * 10)
SHARD_WORDS = 750_000
FILTER_BITS = 1 << 27
BUCKET = 1 << 15  # bits of one bitmap of Spark's bitmap functions
SHARD = struct(lang=STR, words=T.ArrayType(STR), ids=BIN, n=LONG)
COUNTS = struct(lang=STR, gram=STR, f=LONG)


@dataclass(frozen=True)
class Rules:
    longest: int = 3  # words of a phrase
    least: int = 10  # occurrences of a candidate
    absorbed: int = 50  # percent of a candidate's occurrences that a longer one must have to replace it
    top: int = 2000  # phrases a language


class Ids(dict):
    """Ids of words from 1 on, in order of appearance; ends of pieces are 0."""

    def __init__(self) -> None:
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        return i


def shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, words, ids, n): a shard's vocabulary, its texts as unsigned 32-bit ids, 0 at ends of pieces, and its number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab: dict[str, Ids] = defaultdict(Ids)
        parts: dict[str, list[np.ndarray]] = defaultdict(list)
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in parts.items():
                ids = np.concatenate(own)
                words = [w.decode("utf-8") for w in vocab[lang]][1:]
                row = [[lang], [words], [ids.tobytes()], [int((ids > 0).sum())]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.string(), pa.list_(pa.string()), pa.binary(), pa.int64()), strict=True)], names=SHARD.names)
            vocab.clear(), parts.clear()

        for batch in batches:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not text:
                    continue
                lang = "und" if lang is None else lang
                words = text.encode("utf-8").lower().translate(ENDS).replace(END, b" . ").split()
                words.append(END)
                ids = np.fromiter(map(vocab[lang].__getitem__, words), np.uint32, len(words))
                parts[lang].append(ids)
                held += len(ids)
                if held >= SHARD_WORDS:
                    yield from flush()
                    held = 0
        yield from flush()

    return docs.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).mapInArrow(run, SHARD)


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of ids in order of their suffixes' first depth words at least, by prefix doubling."""
    rank = ids.astype(np.int64)
    if depth < 2:
        return np.argsort(rank)
    reach = 1
    while reach < depth:
        after = np.zeros_like(rank)
        after[:-reach] = rank[reach:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + after
        order = np.argsort(key)  # ties in any order: they are split further or are equal to the depth asked for
        key = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        reach *= 2
    return order


def left_in_piece(ids: np.ndarray) -> np.ndarray:
    """How many words each place has up to the end of its piece; 0 at the ends themselves."""
    ends = np.flatnonzero(ids == 0)
    return ends[np.searchsorted(ends, np.arange(len(ids)))] - np.arange(len(ids))


def intervals(ids: np.ndarray, order: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and count of each phrase of m words among the sorted places: the runs of common prefixes of m words or more."""
    if not len(order):
        return order, order
    same = np.ones(len(order) - 1, bool)
    for k in range(m):
        word = ids[order + k]
        same &= word[1:] == word[:-1]
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    return order[first], np.diff(np.concatenate([first, [len(order)]]))


def lang_hash(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))


def word_hashes(words: pa.Array, langs: np.ndarray | np.uint64) -> np.ndarray:
    """Hash of each word and its language, whose hash is given; all words at once."""
    words = words.cast(pa.large_string())
    if not len(words):
        return np.empty(0, np.uint64)
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    h = Hashes(BYTE_CODES[np.frombuffer(data, np.uint8)[at[0] : at[-1]]])
    return mix(h.of(at[:-1] - at[0], at[1:] - at[0]) ^ langs)


def phrase_hashes(words: np.ndarray, m: int) -> np.ndarray:
    """Hash of the m words from each place on, along the first axis."""
    n = max(0, len(words) - m + 1)
    out = np.full((n, *words.shape[1:]), m, np.uint64)
    for k in range(m):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return out


def bit_places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each hash."""
    return (h % np.uint64(FILTER_BITS)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(FILTER_BITS)).astype(np.int64)


def phrase_filter(frequent: DataFrame, m: int) -> np.ndarray:
    """Bitmap of FILTER_BITS bits, set for the phrases of frequent, of m words each. Only the bitmap, of a fixed size, reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                langs = np.array([lang_hash(lang) for lang in batch.column(0).to_pylist()], np.uint64)
                words = pc.split_pattern(batch.column(1), " ").flatten()
                h = phrase_hashes(word_hashes(words, np.repeat(langs, m)).reshape(-1, m).T, m)[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bit_places(h)) + 1)], names=["p"])

    places = frequent.select("lang", "gram").mapInArrow(run, struct(p=LONG))
    rows = places.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        at = (r["b"] - 1) * BUCKET // 8
        bits[at : at + BUCKET // 8] = np.frombuffer(r["bits"], np.uint8)
    return bits


def shard_counts(parts: DataFrame, m: int, known: np.ndarray | None) -> DataFrame:
    """(lang, gram, f) of each shard's phrases of m words whose parts of m - 1 words are in the filter."""
    shared = None if known is None else parts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                ids, vocab = np.frombuffer(data.as_buffer(), np.uint32), words.values
                ok = left_in_piece(ids) >= m
                if shared is not None:
                    hashes = np.concatenate([np.zeros(1, np.uint64), word_hashes(vocab, np.uint64(lang_hash(lang)))])[ids]
                    part = np.ones(len(ids) - m + 2, bool)
                    for p in bit_places(phrase_hashes(hashes, m - 1)):
                        part &= (shared.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
                    ok[: len(ids) - m + 1] &= part[:-1] & part[1:]
                order = suffix_array(ids, m)
                first, f = intervals(ids, order[ok[order]], m)
                for lo in range(0, len(first), 100_000):
                    at = first[lo : lo + 100_000]
                    gram = pc.binary_join_element_wise(*[vocab.take(pa.array(ids[at + k].astype(np.int64) - 1)) for k in range(m)], " ")
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), gram, pa.array(f[lo : lo + 100_000])], names=COUNTS.names)

    return parts.select("lang", "words", "ids").mapInArrow(run, COUNTS)


@contextmanager
def one_row_batches(spark: SparkSession) -> Iterator[None]:
    """For a job that reads shards, rows of several MB each; phrases are small rows and go by the batch."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, "1")
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def counted(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, gram, f, m) of all phrases of up to the longest length with the least count, and (lang, n) of all words."""
    parts = materialize(shards(docs, text_col, lang_col), "shards")
    known, levels = None, []
    for m in range(1, rules.longest + 1):
        level = shard_counts(parts, m, known).groupBy("lang", "gram").agg(F.sum("f").alias("f")).filter(F.col("f") >= rules.least)
        with one_row_batches(docs.sparkSession):
            levels.append(materialize(level.withColumn("m", F.lit(m)), f"phrases-{m}"))
        if m < rules.longest:
            known = phrase_filter(levels[-1], m)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, parts.groupBy("lang").agg(F.sum("n").alias("n"))


def joined_words(words: str, start: F.Column | int, n: F.Column) -> F.Column:
    return F.array_join(F.slice(words, F.lit(start) if isinstance(start, int) else start, n), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrases of two words or more, at the cut that scores lowest."""
    exact = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    cuts = phrases.filter("m > 1").select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a"), F.split("gram", " ", -1).alias("w"), "m")
    cuts = cuts.select("*", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined_words("w", 1, F.col("k")).alias("first"), joined_words("w", F.col("k") + 1, F.col("m") - F.col("k")).alias("rest"))
    for part, name in (("first", "l"), ("rest", "r")):
        counts = phrases.select("lang", F.col("gram").alias(part), F.col("f").alias(name))
        cuts = cuts.join(counts, ["lang", part])
    cuts = cuts.withColumn("top", F.lit(1000000).cast("decimal(7,0)") * (exact("a", 15) * exact("a", 15)).cast("decimal(30,0)")).withColumn("below", exact("l", 18) * exact("r", 18))
    cuts = cuts.withColumn("score", F.expr("cast(top div below as bigint)"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("s")
    return cuts.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "s.l", "s.r", "s.score")


def absorbed(phrases: DataFrame, rules: Rules) -> DataFrame:
    """(lang, phrase) of candidates that a longer candidate replaces."""
    longer = phrases.filter("m > 2").select("lang", "f", F.split("gram", " ", -1).alias("w"), "m")
    inner = longer.select("*", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("k")).select("*", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("k") + 1)).alias("i"))
    most = inner.groupBy("lang", joined_words("w", F.col("i"), F.col("k")).alias("gram")).agg(F.max("f").alias("most"))
    return phrases.join(most, ["lang", "gram"]).filter(100 * F.col("most") >= rules.absorbed * F.col("f")).select("lang", F.col("gram").alias("phrase"))


def best(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    phrases, words = counted(docs, rules, text_col, lang_col)
    rows = materialize(scored(phrases).join(absorbed(phrases, rules), ["lang", "phrase"], "left_anti"), "scored")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the best of each part of a language first, so that no task sorts a whole language
    part = F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(docs.sparkSession)))
    rows = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= rules.top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= rules.top)
    return rows.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
