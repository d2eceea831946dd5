"""Phrase collocations, odd-sketch classes and hard negatives against brute force, on tables with nulls, empty and long
texts, ties, repeated rows, no rows, and extra columns with clashing names."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeloom.llm import collocations, hard_negatives, odd_sketches
from treeloom.llm.common import table

SF = "/root/testdata/sf0.001"
TEXTS = "doc_id long, text string, lang string, rank int, phrase string, n long, node long, token long, kept boolean, d string"
EXTRA = (7, "x", 8, 9, 10, False, "y")


def phrases_of(rows, rules):
    counts, words = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall(r"[^ \t]+", piece)
            words["und" if lang is None else lang] += len(ws)
            for m in range(1, rules.longest + 1):
                counts["und" if lang is None else lang].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < rules.least:
                continue
            longer = [q for q, b in f.items() if len(q) > len(p) and b >= rules.least and 100 * b >= rules.absorbed * a and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not longer:
                score, k = min((int(Fraction(1000000 * a * a, f[p[:k]] * f[p[k:]])), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, words[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[: rules.top], 1)]
    return sorted(out)


def phrase_rows():
    rng = random.Random(3)
    words = ["the", "Of", "Ärger", "été", "x-y", "$5", "no break", "a\x1cb", "𝔘", "end"]
    say = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ". ", "\n", "!?"]) for _ in range(n))
    texts = [say(rng.randint(1, 60)) for _ in range(60)] + [say(4000), "", None, " ", "...", "the the the the", "the of the of end"] + ["a fixed phrase of words"] * 12
    rows = [(i, t, ["en", "de", None, "und"][i % 4], *EXTRA) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, texts[0], None, *EXTRA), (None,) * 10]


@pytest.mark.parametrize("rules", [collocations.Rules(), collocations.Rules(longest=4, least=4, absorbed=40, top=30), collocations.Rules(longest=2, least=2, top=5)])
def test_phrases_against_counting(spark, rules, monkeypatch):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, TEXTS).repartition(3)
    monkeypatch.setattr(collocations, "SHARD_WORDS", 500)
    got = collocations.best(docs, rules)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == phrases_of(rows, rules)
    assert collocations.best(docs.limit(0), rules).collect() == []


def test_phrases_reach_the_filter_by_the_batch(spark, monkeypatch):
    sizes, hashed = spark.sparkContext.accumulator(0), collocations.phrase_hashes
    calls = spark.sparkContext.accumulator(0)

    def counting(words, m):
        if words.ndim == 2:  # of the phrases for the filter, not of a shard
            sizes.add(words.shape[1])
            calls.add(1)
        return hashed(words, m)

    monkeypatch.setattr(collocations, "phrase_hashes", counting)
    text = " ".join(f"a{i} b{i}." for i in range(200))
    docs = spark.createDataFrame([(i, text, "en") for i in range(12)], "doc_id long, text string, lang string").coalesce(1)
    assert collocations.best(docs).count() == 200
    assert sizes.value == 600 and calls.value <= 30


def test_word_hashes_are_of_word_and_language():
    words = ["a", "b", "ab", "ba", "été", "a", "𝔘", "x" * 3000, "é"]
    one = collocations.word_hashes(pa.array(words), np.uint64(collocations.lang_hash("en")))
    assert len(set(one.tolist())) == len(set(words)) and one[0] == one[5]
    assert (collocations.word_hashes(pa.array(["zz", *words, "y"]).slice(1, len(words)), np.uint64(collocations.lang_hash("en"))) == one).all()
    other = collocations.word_hashes(pa.array(words, pa.large_string()), np.array([collocations.lang_hash(x) for x in ["en"] * 4 + ["de"] * 5], np.uint64))
    assert (other[:4] == one[:4]).all() and not set(other[4:].tolist()) & set(one.tolist())
    assert len(collocations.word_hashes(pa.array([], pa.string()), np.uint64(0))) == 0


def test_exact_scores_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("en", "a b", 3 * 10**12, 2), ("en", "a", 7 * 10**12, 1), ("en", "b", 4 * 10**12, 1)], "lang string, gram string, f long, m int")
    row = collocations.scored(phrases).first()
    assert (row.l, row.r, row.score) == (7 * 10**12, 4 * 10**12, 1000000 * 9 * 10**24 // (28 * 10**24))


def test_suffix_array_orders_and_counts():
    rng = np.random.default_rng(5)
    ids = np.append(rng.integers(0, 4, 300), 0).astype(np.uint32)
    for m in (1, 2, 3, 4):
        order = collocations.suffix_array(ids, m)
        assert sorted(order) == list(range(len(ids)))
        heads = [tuple(ids[i : i + m].tolist()) + (-1,) * max(0, i + m - len(ids)) for i in order]
        assert heads == sorted(heads)
        ok = collocations.left_in_piece(ids) >= m
        first, f = collocations.intervals(ids, order[ok[order]], m)
        want = Counter(tuple(ids[i : i + m].tolist()) for i in range(len(ids) - m + 1) if (ids[i : i + m] > 0).all())
        assert {tuple(ids[i : i + m].tolist()): n for i, n in zip(first.tolist(), f.tolist(), strict=True)} == want


def classes_of(rows, words, percent):
    sets = []
    for _, text, *_ in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(ws[i : i + words]) for i in range(max(1, len(ws) - words + 1))} if ws else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and 100 * both >= percent * (len(x) + len(sets[j]) - both):
                up[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(r[0], least.get(top(i), r[0]))
    return Counter((r[0], len(s), least.get(top(i)), r[0] == least.get(top(i))) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def near_rows(seed=4):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    say = lambda n: rng.choices(vocab, k=n)
    texts = []
    for n in (8, 20, 60, 200):  # one text, edited more and more; some pairs lie on the bound
        base = say(n)
        for k in range(14):
            w = list(base)
            for at in rng.sample(range(n), k * n // 100 if n > 50 else k // 4):
                w[at] = f"new{rng.random()}"
            texts.append(" ".join(w))
    shared = " ".join(say(60))  # a long passage that many texts share, which are not alike
    texts += [shared + " " + " ".join(say(45)) for _ in range(60)]
    texts += [texts[0], texts[0].upper(), texts[3] + " more", " ".join(say(3000)), "", " \t\n", None, None, "one", "One", "two words", "𝔘ni ü x y z"]
    rows = [(i, t, "en", *EXTRA) for i, t in enumerate(texts)]
    return [*rows, rows[4], (3, texts[40], "de", *EXTRA), (None, texts[2], "en", *EXTRA), (None, "all alone here, really", "en", *EXTRA), (None,) * 10]


@pytest.mark.parametrize(("words", "percent", "few"), [(4, 80, 48), (4, 80, 1), (5, 80, 48), (3, 90, 0)])
def test_classes_against_all_pairs(spark, words, percent, few, monkeypatch):
    rows = near_rows()
    docs = spark.createDataFrame(rows, TEXTS).repartition(3)
    monkeypatch.setattr(odd_sketches, "FEW", few)
    got = odd_sketches.classes(docs, odd_sketches.Likeness(words, percent)).select("doc_id", "n_shingles", "component_id", "kept")
    want = Counter({(i, n, c, k if i is not None else c is None): m for (i, n, c, k), m in classes_of(rows, words, percent).items()})
    assert Counter(map(tuple, got.collect())) == want


def test_classes_of_no_rows(spark):
    docs = spark.createDataFrame(near_rows(), TEXTS)
    assert odd_sketches.classes(docs.limit(0)).collect() == []
    assert {r.component_id for r in odd_sketches.classes(docs.filter("text is null or doc_id = 1")).collect()} == {1, None} | {r[0] for r in near_rows() if r[1] is None}


def test_odd_sketches_estimate_high_likeness():
    rng = np.random.default_rng(2)
    bound = odd_sketches.most_odd_bits(80)
    bits = {}
    for share in (1.0, 0.95, 0.8, 0.3):
        n = int(1000 * share)
        seen = []
        for _ in range(60):
            u = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
            half = (1000 - n) // 2
            x, y = (odd_sketches.odd_sketch(odd_sketches.min_hashes(s)) for s in (u[: n + half], np.concatenate([u[:n], u[n + half :]])))
            seen.append(sum(int(w).bit_count() for w in (x ^ y).view(np.uint64)))
        bits[share] = seen
    assert max(bits[1.0]) == 0 and max(bits[0.95]) < np.mean(bits[0.8]) < bound
    assert max(bits[0.8]) <= bound < min(bits[0.3])
    # the share of values that differ, out of the count of odd bits
    odd = np.mean(bits[0.8])
    differ = np.log(1 - 2 * odd / odd_sketches.BITS) / np.log(1 - 2 / odd_sketches.BITS) / 2 / odd_sketches.SAMPLES
    assert abs(differ - 0.2) < 0.02


VECTORS = "vec_id long, embedding array<float>, label int, anchor long, win long, rank int, score long, id string"


def negatives_of(rows, mining=hard_negatives.Mining()):
    rows = [r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    width = max([len(r[1]) for r in rows], default=0)
    vs = {r[0]: [int(np.floor(256 * np.float64(np.float32(x)))) for x in r[1]] + [0] * (width - len(r[1])) for r in rows}
    label = {r[0]: (r[2] + 1) % 10 if r[0] % 7 == 0 else r[2] for r in rows}
    out = []
    for a in (i for i in vs if i % 50 == 0):
        scores = sorted((-sum(x * y for x, y in zip(vs[a], vs[b], strict=True)), b) for b in vs if b != a)
        for p, b in [(-s, b) for s, b in scores if label[b] == label[a]][: mining.positives]:
            fits = [(-s, c) for s, c in scores if label[c] != label[a] and mining.least * p <= -100 * s <= mining.most * p]
            out += [(a, b, r, c, p, s) for r, (s, c) in enumerate(fits[: mining.negatives], 1)]
    return sorted(out)


def vector_rows(n, seed=6):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=8)
    rows = []
    for i in range(n):
        v = centre * 0.8 + rng.normal(size=8) * 0.5 if i % 3 else np.ones(8) * 0.3  # a third are equal
        rows.append((i, [float(x) for x in v], int(i % 4), 1, 2, 3, 4, "x"))
    rows += [(n, None, 1, *rows[0][3:]), (n + 1, [1.0, None], 1, *rows[0][3:]), (n + 2, [float("nan")] * 8, 1, *rows[0][3:]), (n + 3, [float("inf")] * 8, 1, *rows[0][3:])]
    rows += [(n + 4, rows[1][1], None, *rows[0][3:]), (None, rows[1][1], 1, *rows[0][3:]), (n + 5, [0.5, 0.5], 2, *rows[0][3:]), (n + 6, [], 2, *rows[0][3:]), (-50, rows[2][1], 3, *rows[0][3:])]
    return [*rows, (None,) * 8]


@pytest.mark.parametrize(("slack", "log2", "slice_rows"), [(16, 10, 2048), (0, 2, 40)])
def test_negatives_against_sorting(spark, slack, log2, slice_rows, monkeypatch):
    rows = vector_rows(260)
    table_ = spark.createDataFrame(rows, VECTORS).repartition(3)
    monkeypatch.setattr(hard_negatives, "SLACK", slack)
    monkeypatch.setattr(hard_negatives, "BUCKETS_LOG2", log2)
    monkeypatch.setattr(hard_negatives, "ROWS_A_SLICE", slice_rows)
    monkeypatch.setattr(hard_negatives, "ANCHORS_A_BLOCK", 4)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(table_, F.col("id") % 50 == 0, label)
    assert sorted(map(tuple, got.collect())) == negatives_of(rows)
    assert len(negatives_of(rows)) > 20


def test_negatives_of_no_rows_and_of_large_components(spark):
    rows = [(i, [float((-1) ** i * 10.0**5 * (1 + i % 5)), 3.0e5], i % 3, 1, 2, 3, 4, "x") for i in range(60)]
    table_ = spark.createDataFrame(rows, VECTORS)
    # products beyond what doubles hold exactly
    assert sorted(map(tuple, hard_negatives.mine(table_, F.col("id") % 50 == 0, F.col("label")).collect())) == [r for r in negatives_of([(i if i % 7 else i, v, lab if i % 7 else (lab - 1) % 10, *x) for i, v, lab, *x in rows])]
    assert hard_negatives.mine(table_.limit(0), F.col("id") % 50 == 0).collect() == []
    assert hard_negatives.mine(table_.filter("vec_id % 50 <> 0"), F.col("id") % 50 == 0).collect() == []


def test_queries_read_whole_tables(spark):
    from treeloom.llm import queries

    docs = table(spark, SF, "documents")
    got = queries.QUERIES["op12_minhash_dedup"](spark, SF)
    assert got.count() == docs.count()
    assert {r.anchor_id % 50 for r in queries.QUERIES["op13_hard_negatives"](spark, SF).select("anchor_id").distinct().collect()} == {0}
