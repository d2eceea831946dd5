"""SentencePiece encoding and decoding with a given model's pieces and scores.

An Aho-Corasick automaton over the pieces reads a text once. At each position its output links give all pieces that
end there, longest first, and each relaxes the position: a single-pass Viterbi. A character that no piece covers
becomes its UTF-8 byte pieces (or the unknown piece, if the model has none).

A path's worth is its sum of scores (an unknown character: the least score less `unknown_penalty`; ties go to the
longest piece). For a unigram model that gives the ids of the sentencepiece library. A model of merges has ranks for
scores: the best path is then a sequence of few and frequent pieces, which decodes to the same text, but is not always
what merging pair by pair gives. Those who need the library's ids for such a model ask for `merges`: there a step is
allowed if its last two pieces are the merged form of their text, and each position has one best last piece (a
sequence is the merged form of its text if and only if each piece is that of its own text and each two neighbours are
that of theirs).

Blanks become U+2581 and one stands before the text. No piece spans the start of a word, so words are encoded one by
one and kept in a bounded cache. decode(encode(text)) is the text, but that U+2581 itself comes back as a blank and
lone surrogates as replacement characters. Null and empty texts have no pieces. Very long texts are encoded whole, in
one pass. Rows are encoded each, repeated ones alike; an empty table gives an empty one; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BIN, DBL, LONG, STR, struct

MARK = "▁"


class Pieces:
    def __init__(self, pieces: list[tuple[str, float]], unknown: int, byte_ids: list[int] | None, normal: list[int], merges: bool, unknown_penalty: float = 10.0, cache_words: int = 300_000):
        """pieces: (text, score) by id; normal: the ids that may be matched in a text; merges: whether scores rank merges."""
        self.pieces, self.unknown, self.bytes, self.merges = pieces, unknown, byte_ids, merges
        self.id_of = {pieces[i][0]: i for i in normal if pieces[i][0]}
        self.automaton = ahocorasick.Automaton()
        for text, i in self.id_of.items():
            if not merges or self.merged(text) == [text]:
                self.automaton.add_word(text, (len(text), pieces[i][1], i))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.missing = min((pieces[i][1] for i in normal), default=0.0) - unknown_penalty
        #: whether no piece goes on after the start of a new word; what stands before a mark inside of a piece
        self.by_word = not any(MARK in x.lstrip(MARK) for x in self.id_of)
        self.before_mark = tuple({x[:k] for x in self.id_of for k in range(1, len(x)) if x[k] in ".,"})
        self.limit, self.cache, self.allowed = cache_words, {}, {}
        self.back = [x.replace(MARK, " ").encode("utf-8", "replace") for x, _ in pieces]
        for b, i in enumerate(byte_ids or []):
            self.back[i] = bytes([b])

    def merged(self, text: str) -> list[str]:
        """The merged form of a short text: always the pair of best score, the first of equals."""
        parts = list(text)
        while len(parts) > 1:
            ranked = [(self.pieces[i][1], -k) for k in range(len(parts) - 1) if (i := self.id_of.get(parts[k] + parts[k + 1])) is not None]
            if not ranked:
                break
            k = -max(ranked)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        key = a * len(self.pieces) + b
        ok = self.allowed.get(key)
        if ok is None:
            if len(self.allowed) > 2_000_000:
                self.allowed.clear()
            x, y = self.pieces[a][0], self.pieces[b][0]
            ok = self.allowed[key] = self.merged(x + y) == [x, y]
        return ok

    def _ids(self, text: str, last: list) -> list[int]:
        """Ids along last, the last piece's id of each prefix; -1 for a character without a piece."""
        ids: list[int] = []
        at = len(text)
        while at:
            i = last[at]
            if i >= 0:
                ids.append(i)
                at -= len(self.pieces[i][0])
                continue
            if self.bytes:
                ids += [self.bytes[b] for b in reversed(text[at - 1].encode("utf-8", "replace"))]
            else:
                ids.append(self.unknown)
            at -= 1
        return ids[::-1]

    def _by_merges(self, text: str) -> tuple[float, list[int]]:
        last, allowed, size_of_all = [None] * (len(text) + 1), self.allowed, len(self.pieces)
        last[0] = -1
        for end, (size, _, i) in self.automaton.iter(text):
            if last[end + 1] is not None:
                continue
            before = last[end + 1 - size]
            if before is None:  # a character without a piece, not met before
                k = end + 1 - size
                while last[k] is None:
                    last[k] = -1
                    k -= 1
                before = -1
            if before < 0:
                last[end + 1] = i
                continue
            ok = allowed.get(before * size_of_all + i)
            if ok or (ok is None and self.follows(before, i)):
                last[end + 1] = i
        ids = self._ids(text, [-1 if x is None else x for x in last])
        return sum(self.pieces[i][1] for i in ids), ids

    def _by_score(self, text: str) -> tuple[float, list[int]]:
        n = len(text)
        score, last = [0.0] + [-np.inf] * n, [-1] * (n + 1)
        done = 0  # positions up to here are settled
        for end, (size, value, i) in self.automaton.iter(text):
            while done < end:  # all before the piece's last character
                done += 1
                if score[done - 1] + self.missing > score[done]:
                    score[done], last[done] = score[done - 1] + self.missing, -1
            new = score[end + 1 - size] + value
            if new > score[end + 1]:
                score[end + 1], last[end + 1] = new, i
        while done < n:
            done += 1
            if score[done - 1] + self.missing > score[done]:
                score[done], last[done] = score[done - 1] + self.missing, -1
        return score[n], self._ids(text, last)

    def best(self, text: str) -> tuple[float, list[int]]:
        """Score and ids of a marked text, in one pass."""
        if not len(self.automaton):
            return self.missing * len(text), self._ids(text, [-1] * (len(text) + 1))
        return self._by_merges(text) if self.merges else self._by_score(text)

    def _word(self, w: str) -> tuple[float, bytes]:
        stem = w.rstrip(".,")
        if stem != w and stem and not stem.endswith(self.before_mark):  # then no piece spans the place
            parts = [self.cache.get(x) or self._word(x) for x in (stem, w[len(stem) :])]
            hit = parts[0][0] + parts[1][0], parts[0][1] + parts[1][1]
        else:
            s, ids = self.best(w)
            hit = s, np.array(ids, dtype="<u4").tobytes()
        if len(w) < 100:
            self.cache[w] = hit
        return hit

    def encode(self, text: str | None) -> tuple[float, bytes]:
        """Total score and little-endian unsigned 32-bit ids of a text."""
        if not text:
            return 0.0, b""
        marked = MARK + text.replace(" ", MARK)
        words = _words(marked) if self.by_word else [marked]
        cache, total, out = self.cache, 0.0, []
        for w in words:
            hit = cache.get(w) or self._word(w)
            total += hit[0]
            out.append(hit[1])
        if len(cache) > self.limit:  # the words met first are mostly the common ones
            self.cache = dict(islice(cache.items(), self.limit // 2))
        return total, b"".join(out)

    def decode(self, ids: bytes) -> str:
        back = self.back
        return b"".join([back[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")[1:]


def _words(marked: str) -> list[str]:
    """Cut before each mark that stands after another character; runs of marks stay together."""
    if MARK + MARK not in marked:
        return [MARK + w for w in marked.split(MARK)[1:]]
    out, lo = [], 0
    at = marked.find(MARK, 1)
    while at > 0:
        if marked[at - 1] != MARK:
            out.append(marked[lo:at])
            lo = at
        at = marked.find(MARK, at + 1)
    return [*out, marked[lo:]]


@lru_cache(maxsize=2)
def load(path: str, merges: bool = False) -> Pieces:
    """Pieces and scores of a SentencePiece model file; one for each Python worker. merges: keep to the merged form."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(n)]
    byte_ids = {int(pieces[i][0][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
    normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return Pieces(pieces, sp.unk_id(), [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else None, normal, merges)


def encode(docs: DataFrame, model_path: str, merges: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, ids (little-endian unsigned 32-bit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path, merges)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                got = [model.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array([b for _, b in got], pa.binary())], names=["doc_id", "score", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, struct(doc_id=LONG, score=DBL, ids=BIN))


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of encoded rows; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            texts = [None if i is None else model.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long"), F.col(ids_col)).mapInArrow(run, struct(doc_id=LONG, text=STR))


def round_trip(docs: DataFrame, model_path: str, merges: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32, score, and whether decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path, merges)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                out = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    score, ids = model.encode(text)
                    out.append((doc, len(ids) // 4, zlib.crc32(ids), score, model.decode(ids) == (text or "")))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()), strict=True)], names=["doc_id", "n_ids", "ids_crc32", "score", "exact"])

    from pyspark.sql.types import BooleanType

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, struct(doc_id=LONG, n_ids=LONG, ids_crc32=LONG, score=DBL, exact=BooleanType()))
