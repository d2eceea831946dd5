"""Best-fit packing of tokenised documents into fixed-length training sequences.

Documents are tokenised where they are read; only piece lengths and checksums are kept, in a table, and shuffled.
Pieces are dealt by hash into groups of a bounded number of pieces, equal rows each on its own, and each group is
packed by vector best-fit: items in decreasing length, each put into the feasible bin that the chosen rule likes best
by its residual tokens, documents and attention cost (the sum of squared lengths). Every group leaves about one bin
partly empty, so the waste is a fixed small share and the work is linear in the input.

Null text counts as empty (one separator token). Very long texts are tokenised whole and cut. Repeated rows are packed
each on its own; pieces of equal length go in order of id, piece and checksum. An empty table gives an empty result.
Columns other than the id and the text are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import INT, LONG, groups_for, materialize, struct

#: row: place of the document among those of its task, which tells equal rows apart
PIECES = struct(doc_id=LONG, piece=INT, start=LONG, length=LONG, ids_crc32=LONG, row=LONG)
PACKED = struct(doc_id=LONG, piece=INT, start=LONG, length=LONG, ids_crc32=LONG, sequence_id=LONG, offset=LONG)


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold: tokens, documents, and attention cost.

    By default the latter two are what the tokens imply, so that they rank bins but never ask for more sequences.

    weights say how much each residual, as a share of its capacity, counts in the choice of a bin.
    """

    tokens: int = 2048
    documents: int | None = None
    attention: float | None = None
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = "norm"  # or "dot"

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or float(self.tokens) ** 2], dtype=np.float64)


class FastTokenizer:
    """Ids of whole texts, as the tokenizers library gives them for a byte-level BPE file.

    Where the file's merges are in order of their ids, the same vocabulary as ranks gives the same ids at several times
    the speed; texts with an added token's string, which the library cuts out first, and other files go to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        vocab, merges = parts["model"]["vocab"], parts["model"]["merges"]
        self.added = [t["content"] for t in parts["added_tokens"]]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        self.ranks = None
        plain = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if parts["pre_tokenizer"] == plain and parts["normalizer"] is None and made == sorted(made):
            back = {v: k for k, v in byte_letters().items()}
            ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in self.added}
            self.ranks = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out = []
        for t in texts:
            if self.ranks is not None and not any(a in t for a in self.added):
                ids = self.ranks.encode_ordinary(t)
            else:
                ids = self.tokenizer.encode(t, add_special_tokens=False).ids
            out.append(np.fromiter(ids, "<u4", len(ids)).tobytes())
        return out


def byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level BPE: itself where it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + n) for n, b in enumerate(others)}


@lru_cache(maxsize=1)
def worker_tokenizer(path: str) -> FastTokenizer:
    """One for each Python worker, kept over its tasks."""
    return FastTokenizer(path)


def cut_points(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one, or full ones of which the first may be shorter."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = worker_tokenizer(tokenizer_path)
        end, met = np.array([separator], dtype="<u4").tobytes(), 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for lo in range(0, len(ids), 200):
                rows = []
                for doc, data in zip(ids[lo : lo + 200], tok.encode(texts[lo : lo + 200]), strict=True):
                    data += end
                    rows += [(doc, k, s, n, zlib.crc32(data[4 * s : 4 * (s + n)]), met) for k, (s, n) in enumerate(cut_points(len(data) // 4, size))]
                    met += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=PIECES.names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Items go in decreasing length; ties keep their order.

    rule "norm" takes the feasible bin with the smallest weighted squared residual after the item is placed;
    rule "dot" the one whose residual has the largest weighted dot-product with the item.
    """
    cap, w = capacity.vector(), np.asarray(capacity.weights)
    n = len(lengths)
    left = np.empty((3, n))
    opened = 0
    bins, offsets = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
    live = np.empty(0, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    smallest = lengths.min() if n else 0
    for step, i in enumerate(order):
        size = float(lengths[i])
        need = np.array([size, 1.0, size * size])
        if (need > cap).any():
            raise ValueError(f"an item of {size:.0f} tokens exceeds the capacity {cap.tolist()}")
        room = left[:, live]
        fits = np.flatnonzero((room >= need[:, None]).all(axis=0))
        if len(fits):
            rest, unit = room[:, fits] / cap[:, None], need / cap
            rank = ((rest - unit[:, None]) ** 2 * w[:, None]).sum(0) if capacity.rule == "norm" else -(rest * unit[:, None] * w[:, None]).sum(0)
            b = live[fits[np.argmin(rank)]]
        else:
            b, opened = opened, opened + 1
            left[:, b] = cap
            live = np.append(live, b)
        bins[i], offsets[i] = b, int(cap[0] - left[0, b])
        left[:, b] -= need
        if left[0, b] < smallest or left[1, b] < 1:
            live = live[live != b]
        elif step % 512 == 511:
            live = live[left[0, live] >= smallest]
    return bins, offsets


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), group_pieces: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to pieces, a table. Groups are dealt by a hash of the piece and of its place in its task."""
    groups = groups_for(pieces.count(), group_pieces)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = best_fit(frame["length"].to_numpy(), capacity)
        frame["sequence_id"], frame["offset"] = (int(frame["grp"].iloc[0]) << 32) + bins, offsets
        return frame[PACKED.names]

    grp = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row"), F.lit(groups)).alias("grp")
    return pieces.select("*", grp).groupBy("grp").applyInPandas(run, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: Capacity = Capacity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack: one row per piece."""
    return pack(materialize(tokenize_pieces(docs, tokenizer_path, capacity.tokens, 0, id_col, text_col), "pieces"), capacity)
