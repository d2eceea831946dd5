"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in chunks: one gated unit layer forwards, one backwards, and a linear layer over both
states labels every position. A document's probabilities are the mean of those of all its positions. It is trained
in numpy by backpropagation through time (Adam), on a bounded sample: about `per_class` documents a language, chosen
by a hash of the id, never from the held-out fold. Applying it is one pass over all rows, whole texts, no shuffle.

Null texts and texts without a letter get `und` with score 0.0, as does every row if no label can be learned from.
Invalid code points are replaced, not dropped. Very long texts are read whole. Rows are judged alone, repeated ones
alike; ties go to the language that comes first in order; an empty table gives an empty one; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DBL, LONG, STR, held_out, struct, training_sample

UNKNOWN = "und"
CHUNK = 96


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Direction:
    """One gated recurrent layer: rows of `inputs` are a byte's share of update, reset and new state."""

    inputs: np.ndarray  # 256 x 3H
    state: np.ndarray  # H x 3H
    bias: np.ndarray  # 3H, added inside the reset product for the last third

    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.state, self.bias]


def new_direction(rng: np.random.Generator, hidden: int) -> Direction:
    return Direction(rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32), (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32), np.zeros(3 * hidden, np.float32))


def states(d: Direction, x: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """States (T, H, B) of byte rows x (T, B): forward without what training keeps, one chunk a column. Masked positions leave a zero state."""
    steps, b = x.shape
    hs = d.state.shape[0]
    two = 2 * hs
    inputs, state, bias = np.ascontiguousarray(d.inputs.T), np.ascontiguousarray(d.state.T), d.bias[:, None].copy()
    half = np.where(np.arange(3 * hs) < two, np.float32(0.5), np.float32(1.0))[:, None]  # sigmoid by tanh of half
    inputs, state, bias = inputs * half, state * half, bias * half
    inputs[:two] += bias[:two]
    h = np.zeros((hs, b), np.float32)
    out = np.empty((steps, hs, b), np.float32)
    gates, mixed, gap = (np.empty((k, b), np.float32) for k in (3 * hs, 3 * hs, hs))
    zr, z, r, new, own = gates[:two], gates[:hs], gates[hs:two], gates[two:], mixed[two:]
    for t in range(steps):
        np.take(inputs, x[t], axis=1, out=gates, mode="clip")
        np.matmul(state, h, out=mixed)
        zr += mixed[:two]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        own += bias[two:]
        own *= r
        new += own
        np.tanh(new, out=new)
        np.subtract(h, new, out=gap)
        gap *= z
        h = out[t]
        np.add(new, gap, out=h)
        if mask is not None:
            h *= mask[t]
    return out


def forward(d: Direction, x: np.ndarray) -> tuple[np.ndarray, list]:
    """States (T, B, H) of byte rows x (T, B), and what backward needs."""
    hs = d.state.shape[0]
    h, out, kept = np.zeros((x.shape[1], hs), np.float32), np.empty((*x.shape, hs), np.float32), []
    for t in range(len(x)):
        gates, mixed = d.inputs[x[t]], h @ d.state + d.bias
        zr = sigmoid(gates[:, : 2 * hs] + mixed[:, : 2 * hs])
        new = np.tanh(gates[:, 2 * hs :] + zr[:, hs:] * mixed[:, 2 * hs :])
        kept.append((zr, new, mixed[:, 2 * hs :], h))
        h = new + zr[:, :hs] * (h - new)
        out[t] = h
    return out, kept


def backward(d: Direction, x: np.ndarray, kept: list, into: np.ndarray) -> list[np.ndarray]:
    """Gradients of a direction's parts, from those of its states (T, B, H)."""
    hs = d.state.shape[0]
    g_in, g_state, g_bias = (np.zeros_like(p) for p in d.parts())
    carry, gate = np.zeros_like(into[0]), np.empty((*x.shape, 3 * hs), np.float32)
    for t in range(len(x) - 1, -1, -1):
        zr, new, mixed, before = kept[t]
        z, r = zr[:, :hs], zr[:, hs:]
        g = into[t] + carry
        g_new = g * (1 - z) * (1 - new * new)
        g_z = g * (before - new) * z * (1 - z)
        g_r = g_new * mixed * r * (1 - r)
        gate[t] = np.concatenate([g_z, g_r, g_new], axis=1)
        g_mixed = np.concatenate([g_z, g_r, g_new * r], axis=1)
        g_state += before.T @ g_mixed
        g_bias += g_mixed.sum(0)
        carry = g * z + g_mixed @ d.state.T
    for c in range(3 * hs):
        g_in[:, c] = np.bincount(x.ravel(), gate[:, :, c].ravel(), 256)
    return [g_in, g_state, g_bias]


@dataclass
class Network:
    labels: list[str]
    ahead: Direction
    back: Direction
    out: np.ndarray  # 2H x labels
    bias: np.ndarray
    #: best scores below this are those of texts in no learned language
    least_score: float = 0.0

    def parts(self) -> list[np.ndarray]:
        return [*self.ahead.parts(), *self.back.parts(), self.out, self.bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions of full chunks x (T, B) with labels y (B), and its gradients."""
        steps, b = x.shape
        hs = self.ahead.state.shape[0]
        hf, kept_f = forward(self.ahead, x)
        hb, kept_b = forward(self.back, x[::-1])
        both = np.concatenate([hf, hb[::-1]], axis=2)
        logits = both @ self.out + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        loss = -float(np.log(p[:, np.arange(b), y] + 1e-9).mean())
        p[:, np.arange(b), y] -= 1
        p /= steps * b
        g_out = np.einsum("tbh,tbl->hl", both, p)
        g_both = p @ self.out.T
        gf = backward(self.ahead, x, kept_f, g_both[:, :, :hs])
        gb = backward(self.back, x[::-1], kept_b, g_both[::-1, :, hs:])
        return loss, [*gf, *gb, g_out, p.sum((0, 1))]

    def pooled(self, x: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Sum over positions of each chunk's label probabilities: (B, labels)."""
        hs, k = self.ahead.state.shape[0], len(self.labels)
        hf = states(self.ahead, x, mask)
        hb = states(self.back, x[::-1], None if mask is None else mask[::-1])[::-1]
        total, ones = np.zeros((k, x.shape[1])), np.ones((k, k), np.float32)
        ahead, back, bias = np.ascontiguousarray(self.out[:hs].T), np.ascontiguousarray(self.out[hs:].T), self.bias[:, None]
        for t in range(len(x)):
            p = ahead @ hf[t]
            p += back @ hb[t]
            p += bias
            np.exp(p, out=p)
            p /= ones @ p
            if mask is not None:
                p *= mask[t]
            total += p
        return total.T

    def documents(self, texts: list[bytes], chunk: int = CHUNK, at_once: int = 1024) -> np.ndarray:
        """Mean label probabilities over all bytes of each text."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        total = np.zeros((len(texts), len(self.labels)))
        flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
        starts = np.cumsum(sizes) - sizes
        full = sizes // chunk
        owner = np.repeat(np.arange(len(texts)), full)
        if len(owner):
            first = np.repeat(starts, full) + chunk * (np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full))
            for lo in range(0, len(owner), at_once):
                x = np.ascontiguousarray(flat[first[lo : lo + at_once, None] + np.arange(chunk)].T)
                got = self.pooled(x, None)
                for c in range(got.shape[1]):
                    total[:, c] += np.bincount(owner[lo : lo + at_once], got[:, c], len(texts))
        tails = np.flatnonzero(sizes % chunk)
        for lo in range(0, len(tails), at_once):
            who = tails[lo : lo + at_once]
            n = (sizes % chunk)[who]
            at = starts[who] + full[who] * chunk
            steps = int(n.max())
            place = np.arange(steps)[:, None]
            mask = place < n[None, :]
            x = np.where(mask, flat[np.minimum(at[None, :] + place, len(flat) - 1)], 0)
            total[who] += self.pooled(x, mask.astype(np.float32))
        return total / np.maximum(sizes, 1)[:, None]


def train(texts: list[bytes], labels: list[str], hidden: int = 8, steps: int = 300, batch: int = 128, chunk: int = CHUNK, rate: float = 0.02, seed: int = 1) -> Network:
    rng = np.random.default_rng(seed)
    kinds = sorted(set(labels))
    net = Network(kinds, new_direction(rng, hidden), new_direction(rng, hidden), rng.normal(0, 0.3, (2 * hidden, len(kinds))).astype(np.float32), np.zeros(len(kinds), np.float32))
    flat = np.frombuffer(b"".join(t if len(t) >= chunk else t + b" " * (chunk - len(t)) for t in texts), dtype=np.uint8)
    sizes = np.array([max(len(t), chunk) for t in texts])
    starts = np.cumsum(sizes) - sizes
    of_kind = [np.flatnonzero(np.array(labels) == k) for k in kinds]
    m, v = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(kinds), batch)
        who = np.array([rng.choice(of_kind[k]) for k in y])
        at = starts[who] + rng.integers(0, sizes[who] - chunk + 1)
        x = np.ascontiguousarray(flat[at[:, None] + np.arange(chunk)].T)
        _, grads = net.gradients(x, y)
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, a, b in zip(net.parts(), grads, m, v, strict=True):
            g = np.clip(g, -1, 1)
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return net


def encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def fit(docs: DataFrame, per_class: int = 250, share: float = 0.55, **options) -> Network | None:
    """Trains on the bounded sample; None if there is nothing to learn from.

    The bound for rejection lies a `share` of the way from an even guess to the score that 99 % of the sample reach, so
    a text that is half in one language and half in another stays.
    """
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    rows = training_sample(known, "lang", "doc_id", per_class).collect()
    rows = sorted(((r.doc_id, r.text, r.lang) for r in rows if any(c.isalpha() for c in r.text)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not rows:
        return None
    texts = [encode(t) for _, t, _ in rows]
    net = train(texts, [lang for _, _, lang in rows], **options)
    even = 1 / len(net.labels)
    net.least_score = even + share * max(0.0, float(np.quantile(net.documents(texts).max(axis=1), 0.01)) - even)
    return net


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 250):
                part = batch.slice(lo, 250)
                texts = part.column(1).to_pylist()
                lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                sure = [i for i, t in enumerate(texts) if t and model and any(c.isalpha() for c in t)]
                if sure:
                    p = model.documents([encode(texts[i]) for i in sure])
                    best = p.argmax(axis=1)
                    for k, i in enumerate(sure):
                        lang[i], score[i] = model.labels[best[k]], float(min(1.0, p[k, best[k]]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    got = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, struct(doc_id=LONG, lang_pred=STR, score=DBL))
    return got.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, net: Network | None, least_score: float | None = None, text_col: str = "text") -> DataFrame:
    """The rows, unchanged, whose text has a letter and whose likeliest language has at least least_score, by default the
    network's own bound. Without a network nothing is known about languages, and all texts with a letter stay."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 250):
                part = batch.slice(lo, 250)
                texts = part.column(at).to_pylist()
                sure = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
                if sure and model:
                    p = model.documents([encode(texts[i]) for i in sure]).max(axis=1)
                    bound = model.least_score if least_score is None else least_score
                    sure = [i for i, s in zip(sure, p, strict=True) if s >= bound]
                if sure:
                    yield part.take(pa.array(sure, pa.int64()))

    return docs.mapInArrow(run, docs.schema)
