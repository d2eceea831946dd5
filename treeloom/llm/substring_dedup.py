"""Substring dedup by suffix automata: removes words in a run of `length` words that an earlier document has too.

Reference shards hold the spans of words that may repeat (see repeats), dealt by their leading words, so that a
document's span meets exactly the shard that can match it: every shard's automata stay small, and no shard has to
be sent to every document. In a shard each group of spans is streamed in order of doc_id: matching statistics
against the automaton of the spans before give the repeated runs, then the span joins the automaton.

Words are maximal runs of anything but ASCII white space, unchanged. Null text has none. A window counts as earlier
if it starts in a document with a smaller id; rows with the same id or a null one are no earlier than each other,
and a null id comes after all others. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONG, STR, struct
from .repeats import NO_ID, Windows, covered, keyed, repeats, text_words_kept, with_spans, word_codes


class SuffixAutomaton:
    """Of several sequences: each starts at the root again, so no match crosses from one to the next."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after), self.link.append(link), self.length.append(length)
        return len(self.next) - 1

    def add(self, tokens: list[int]) -> None:
        last = 0
        for t in tokens:
            last = self._extend(last, t)

    def _split(self, p: int, t: int, q: int) -> int:
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, t: int) -> int:
        q = self.next[last].get(t)
        if q is not None:
            return self._split(last, t, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, t, self.next[p][t])
        return new

    def statistics(self, tokens: list[int]) -> list[int]:
        """For each position, the length of the longest match that ends there."""
        at, n, out = 0, 0, []
        after, link, length = self.next, self.link, self.length
        for t in tokens:
            while at and t not in after[at]:
                at = link[at]
                n = length[at]
            if t in after[at]:
                at, n = after[at][t], n + 1
            else:
                n = 0
            out.append(n)
        return out


def shard_matcher(window: int):
    def match(frame: pd.DataFrame) -> list[np.ndarray]:
        flags = [np.zeros(c, bool) for c in frame["count"]]
        core, doc, tokens = frame["core"].to_numpy(), frame["doc"].to_numpy(), frame["tokens"].tolist()
        edges = np.flatnonzero(np.concatenate([[True], core[1:] != core[:-1], [True]]))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo < 2:
                continue
            automaton, waiting, now = SuffixAutomaton(), [], None
            for r in range(lo, hi):
                if doc[r] != now:
                    for ts in waiting:
                        automaton.add(ts)
                    waiting, now = [], doc[r]
                ts = np.frombuffer(tokens[r], np.uint64).tolist()
                stats = automaton.statistics(ts)
                flags[r][:] = np.array(stats[window - 1 :]) >= window
                if stats[-1] < len(ts):  # else the automaton has all of it
                    waiting.append(ts)
        return flags

    return match


OUT = struct(doc_id=LONG, n_words=LONG, n_removed=LONG, kept=STR)


def _removals(docs: DataFrame, length: int, id_col: str, text_col: str, rest: list[str]) -> DataFrame:
    """doc_id, text, doc, spans and the columns of rest, as rest.*, of every row."""
    reach = max(1, length * 7 // 10)
    w = Windows(length, reach, max(1, min(3, length - reach)), word_codes)
    rows = keyed(docs, id_col, text_col, rest)
    texts, spans = repeats(rows.select("doc_id", "text", "d"), w, True, shard_matcher(length), lambda t: np.frombuffer(t, np.uint64), word_codes)
    return with_spans(rows, texts, spans)


def kept_words(doc: int, text: str, first: int | None, spans: list | None, length: int) -> tuple[int, list[bytes]]:
    """How many words a text has, and those that stay. first: the smallest id with this text, if several rows have it."""
    ws = text_words_kept(text)
    n = len(ws)
    if first is not None and first < doc and n >= length:
        return n, []
    if spans:
        gone = covered(n, spans, length)
        return n, [x for x, g in zip(ws, gone, strict=True) if not g]
    return n, ws


def dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the remaining words, joined by blanks) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                out = []
                for doc, text, first, spans in zip(*(c.to_pylist() for c in batch.slice(lo, 200).columns), strict=True):
                    n, ws = kept_words(doc, text, first, spans, length)
                    out.append((None if doc == NO_ID else doc, n, n - len(ws), b" ".join(ws).decode("utf-8", "surrogatepass")))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)], names=OUT.names)

    return _removals(docs, length, id_col, text_col, []).select("doc_id", "text", "doc", "spans").mapInArrow(run, OUT)


def clean(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without the repeated words. A text that loses none keeps its white space; one that loses all goes."""
    rest = [c for c in docs.columns if c != text_col]
    rows = _removals(docs, length, id_col, text_col, rest).select("doc_id", "text", "doc", "spans", "rest")
    out = T.StructType([T.StructField("text", STR), rows.schema["rest"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part, texts, stay = batch.slice(lo, 200), [], []
                for i, (doc, text, first, spans) in enumerate(zip(*(c.to_pylist() for c in part.columns[:4]), strict=True)):
                    n, ws = kept_words(doc, text, first, spans, length)
                    if len(ws) == n or ws:
                        stay.append(i)
                        texts.append(text if len(ws) == n else b" ".join(ws).decode("utf-8", "surrogatepass"))
                if stay:
                    yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), part.column(4).take(pa.array(stay, pa.int64()))], names=["text", "rest"])

    got = rows.mapInArrow(run, out)
    return got.select(*[F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns])


def digest(docs: DataFrame, length: int = 50) -> DataFrame:
    return dedup(docs, length).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
