"""Suffix-array dedup: removes every byte covered by a string of `length` bytes that also starts elsewhere.

Suffixes that start at anchors (see repeats) are dealt to buckets by sampled splitters over their leading bytes. A
bucket sorts its suffixes by multikey quicksort, 8 bytes a step, only tied runs going on to the next; the common
prefix with the neighbours bounds how far any of a suffix's windows can repeat, and the windows within that bound
are compared. Cores that reach over a bucket's edge are compared across buckets as well.

Texts are compared as UTF-8 bytes and strings never cross documents. Null text counts as empty. Repeated rows are
copies of each other, whatever their ids; null ids stay null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BIN, LONG, struct
from .repeats import BYTE_CODES, NO_ID, Hashes, Windows, covered, keyed, repeats, with_spans


def text_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def byte_codes(text: str | None) -> np.ndarray:
    return BYTE_CODES[text_bytes(text)]


def multikey_sort(keys: np.ndarray) -> np.ndarray:
    """Order of the rows of keys (n, depth): ternary partition by one key a step, until no run is tied."""
    n, depth = keys.shape
    order, group, tied = np.arange(n), np.zeros(n, np.int64), np.arange(n)
    for k in range(depth):
        if len(tied) < 2:
            break
        # tied holds places in order whose runs are equal so far
        rows = order[tied]
        by = np.lexsort((keys[rows, k], group[tied]))
        rows, g = rows[by], group[tied][by]
        order[tied] = rows
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (keys[rows[1:], k] != keys[rows[:-1], k])])
        group[tied] = tied[np.flatnonzero(new)][np.cumsum(new) - 1]
        size = np.bincount(np.cumsum(new) - 1)
        tied = tied[size[np.cumsum(new) - 1] > 1]
    return order


def neighbour_prefix(cells: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Longest common prefix, in bytes, of each row with either neighbour in sorted order."""
    n, width = cells.shape
    out = np.zeros(n, np.int64)
    for lo in range(0, n - 1, 4096):
        a, b = order[lo : min(lo + 4096, n - 1)], order[lo + 1 : min(lo + 4096, n - 1) + 1]
        differ = cells[a] != cells[b]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        np.maximum.at(out, a, common)
        np.maximum.at(out, b, common)
    return out


def bucket_matcher(length: int):
    width = -(-length // 8) * 8

    def match(frame: pd.DataFrame) -> list[np.ndarray]:
        tokens, off, count = frame["tokens"].tolist(), frame["off"].to_numpy(), frame["count"].to_numpy()
        cells = np.zeros((len(tokens), width), np.uint8)
        for r, (t, o) in enumerate(zip(tokens, off, strict=True)):
            part = np.frombuffer(t, np.uint8)[o : o + length]
            cells[r, : len(part)] = part
        order = multikey_sort(cells.view(">u8"))
        bound = neighbour_prefix(cells, order)
        tries = np.clip(np.minimum(count, bound - length + off + 1), 0, None)
        codes = [BYTE_CODES[np.frombuffer(t, np.uint8)] for t in tokens]
        base = np.cumsum([0] + [len(c) for c in codes[:-1]])
        k = np.arange(tries.sum()) - np.repeat(np.cumsum(tries) - tries, tries)
        at = k + np.repeat(base, tries)
        flags = [np.zeros(c, bool) for c in count]
        if len(at):
            _, inverse, n = np.unique(Hashes(np.concatenate(codes)).of(at, at + length), return_inverse=True, return_counts=True)
            twice = n[inverse] > 1
            for r, (lo, m) in enumerate(zip(np.cumsum(tries) - tries, tries, strict=True)):
                flags[r][:m] = twice[lo : lo + m]
        return flags

    return match


OUT = struct(doc_id=LONG, n_bytes=LONG, n_removed=LONG, n_spans=LONG, kept=BIN)


def dedup(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes) of every row."""
    reach = max(1, length * 3 // 4)
    w = Windows(length, reach, max(1, min(16, length - reach)), byte_codes)
    rows = keyed(docs, id_col, text_col)
    texts, spans = repeats(rows, w, False, bucket_matcher(length), lambda t: BYTE_CODES[np.frombuffer(t, np.uint8)], text_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                out = []
                for doc, text, copies, spans in zip(*(c.to_pylist() for c in batch.slice(lo, 200).columns), strict=True):
                    data = text_bytes(text)
                    gone = np.full(len(data), True) if (copies or 1) > 1 and len(data) >= length else covered(len(data), spans or [], length)
                    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    out.append((None if doc == NO_ID else doc, len(data), int(gone.sum()), runs, data[~gone].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.binary()], strict=True)], names=OUT.names)

    return with_spans(rows, texts, spans).select("doc_id", "text", "copies", "spans").mapInArrow(run, OUT)


def digest(docs: DataFrame, length: int = 400) -> DataFrame:
    return dedup(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
