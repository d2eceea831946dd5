"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models over the letters of words, one of toxic and one of ordinary documents. Both back
off to the same lower orders, whose continuation counts are those of the two classes together, so a rare expression
that neither class knows weighs nothing, while a new form of a known insult keeps the weight of its stem. A word's
evidence is its log-likelihood ratio, a document's is length-normalised: the mean a word over the whole text, the
mean a word of strong words only, and that of its best run of `run_words` words, for insults in a long ordinary text.
A logistic curve, fitted by cross-validation between two halves of the sample, turns the three into a score.

The models are fitted on a bounded sample: about `per_class` documents of each label value, chosen by a hash of the
id. Scoring is one pass over all rows without a shuffle, of whole texts.

Null and empty texts get the score of a text without evidence. Rows without a usable label are never learned from;
without labels of both values the score is 0.0 throughout. Repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DBL, LONG, held_out, struct, training_sample

DISCOUNT = 0.75
ORDER = 6
STRONG = 2.0


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def grams(word: str, order: int = ORDER) -> list[str]:
    """Each letter of a word, and its end, with the order - 1 letters before it."""
    padded = "^" * (order - 1) + word.strip(".,;:!?\"'()|") + "$"
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


@dataclass
class Ratios:
    """log P(toxic) - log P(ordinary) of letters after their history; an unseen letter has that of the history's back-off."""

    seen: dict[str, float]
    backoff: dict[str, float]
    cache: dict[str, float] = field(default_factory=dict)

    def word(self, word: str) -> float:
        seen, backoff = self.seen, self.backoff
        total = 0.0
        for g in grams(word):
            r = seen.get(g)
            total += backoff.get(g[:-1], 0.0) if r is None else r
        return total

    def of(self, texts: list[str | None], run_words: int) -> np.ndarray:
        """Per text: mean ratio a word, mean of the strong ones a word, mean of the best run."""
        if len(self.cache) > 500_000:
            self.cache = {}
        cache, out = self.cache, np.zeros((len(texts), 3))
        for k, text in enumerate(texts):
            ws = words_of(text)
            if not ws:
                continue
            for w in ws:
                if w not in cache:
                    cache[w] = self.word(w)
            ratio = np.array([cache[w] for w in ws])
            total = np.concatenate([[0.0], np.cumsum(np.maximum(ratio, -1.0))])
            run = min(run_words, len(ratio))
            out[k] = ratio.mean(), ratio[np.abs(ratio) > STRONG].sum() / len(ratio), (total[run:] - total[:-run]).max() / run_words
        return out


def kneser_ney(words: list[Counter]) -> Ratios:
    """Ratios of the two classes' models (0 ordinary, 1 toxic) from how often each class has each word."""
    top = [Counter(), Counter()]
    for c in (0, 1):
        for w, n in words[c].items():
            for g in grams(w):
                top[c][g] += n
    # shared lower orders: in how many longer contexts a letter follows, over both classes
    orders = [set(top[0]) | set(top[1])]
    shared: list[tuple[Counter, Counter, Counter]] = []
    while len(next(iter(orders[-1]))) > 1:
        follow = Counter(g[1:] for g in orders[-1])
        total, kinds = Counter(), Counter()
        for g, n in follow.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        shared.append((follow, total, kinds))
        orders.append(set(follow))
    flat = 1.0 / max(1, len(shared[-1][0]))
    known: list[dict[str, float]] = [{} for _ in shared]
    for level in range(len(shared) - 1, -1, -1):
        follow, total, kinds = shared[level]
        for g, n in follow.items():
            h = g[:-1]
            lower = known[level + 1][g[1:]] if level + 1 < len(shared) else flat
            known[level][g] = (n - DISCOUNT + DISCOUNT * kinds[h] * lower) / total[h]
    heads, kinds = [defaultdict(int), defaultdict(int)], [defaultdict(int), defaultdict(int)]
    for c in (0, 1):
        for g, n in top[c].items():
            heads[c][g[:-1]] += n
            kinds[c][g[:-1]] += 1
    weight = [{h: DISCOUNT * kinds[c][h] / n for h, n in heads[c].items()} for c in (0, 1)]

    def p(c: int, g: str) -> float:
        h, lower = g[:-1], known[0][g[1:]]
        return max(top[c][g] - DISCOUNT, 0) / heads[c][h] + weight[c][h] * lower if h in weight[c] else lower

    seen = {g: float(np.log(p(1, g) / p(0, g))) for g in orders[0]}
    both = set(weight[0]) | set(weight[1])
    return Ratios(seen, {h: float(np.log(weight[1].get(h, 1.0) / weight[0].get(h, 1.0))) for h in both})


def count_words(rows: list) -> list[Counter]:
    out = [Counter(), Counter()]
    for r in rows:
        out[r.toxic].update(words_of(r.text))
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weights of a logistic curve by Newton's method; the last one is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.clip(np.linalg.solve(h, x.T @ (y - p) - ridge * w), -5, 5)
    return w


@dataclass
class Model:
    ratios: Ratios | None
    weights: np.ndarray
    run_words: int

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.ratios is None:
            return np.zeros(len(texts))
        x = self.ratios.of(texts, self.run_words)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, run_words: int = 20) -> Model:
    """Learns from rows outside the held-out fold. per_class bounds the sample, whatever the tables' size."""
    known = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(~held_out("doc_id"))
    chosen = training_sample(known, "toxic", "doc_id", per_class)
    # about two times per_class ids at any size, so they can be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).alias("half")).collect()
    if len({(r.toxic, r.half) for r in rows}) < 4:
        return Model(None, np.zeros(4), run_words)
    x, y = [], []
    for h in (0, 1):
        ratios = kneser_ney(count_words([r for r in rows if r.half == h]))
        x.append(ratios.of([r.text for r in rows if r.half != h], run_words))
        y += [r.toxic for r in rows if r.half != h]
    y = np.array(y, dtype=float)
    weights = logistic(np.concatenate(x), y)
    share = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    # the sample holds both labels about alike; the constant moves to their share among all labelled rows
    weights[-1] += np.log(share[1] / share[0]) - np.log(y.sum() / (1 - y).sum())
    return Model(kneser_ney(count_words(rows)), weights, run_words)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. The model's size is bounded by the sample."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.score(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, struct(doc_id=LONG, score=DBL))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
