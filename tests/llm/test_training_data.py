"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties, repeated
rows, no rows, and extra columns with clashing names."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from treeloom.llm import fingerprints, language, neighbours, ngram_join, packing, pieces, pii, substring_dedup, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d string, spans string, component string"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def make_rows():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdeßé", k=rng.randint(1, 6))) for _ in range(300)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    passage, texts = say(90), []
    for i in range(14):
        texts.append(say(rng.randint(5, 150)) + (" " + passage + " " if i % 3 == 0 else "\n") + say(rng.randint(5, 60)))
    base = say(160).split(" ")
    for i in range(5):  # near copies
        w = list(base)
        w[10 * i] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0], say(2500), say(20) * 30, "", " \t\n ", None, None, "123 456", "one", "Two  blanks,  three   and\ttab <|endoftext|>", "𝔘nicode 🙂 " + say(70)]
    rows = [(i, t, ["en", "de", None][i % 3] if i % 5 else "en", f"s{i % 2}", len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, texts[2], "en", "s", 1, "x", "y", "z"), (None, None, None, None, None, None, None, None)]


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_pieces_match_the_library(docs, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    encoded = pieces.encode(docs, path, merges=True)
    got = Counter((r.doc_id, bytes(r.ids)) for r in encoded.collect())
    assert got == Counter((r[0], np.array(sp.encode(r[1] or ""), "<u4").tobytes()) for r in ROWS)
    assert Counter((r.doc_id, r.text) for r in pieces.decode(encoded, path).collect()) == Counter((r[0], r[1] or "") for r in ROWS)
    assert pieces.round_trip(none, path).count() == 0


def test_pieces_of_a_model_file_are_the_best_path(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = pieces.load(path)
    longest = max(map(len, model.id_of))

    def best(text):  # plain dynamic programme over all pieces, without words, cache or automaton
        worth = [0.0] + [-np.inf] * len(text)
        for end in range(1, len(text) + 1):
            worth[end] = worth[end - 1] + model.missing
            for n in range(1, min(longest, end) + 1):
                i = model.id_of.get(text[end - n : end])
                if i is not None:
                    worth[end] = max(worth[end], worth[end - n] + model.pieces[i][1])
        return worth[-1]

    got = pieces.encode(docs, path).collect()
    texts = {r[0]: r[1] for r in ROWS if r[0] is not None}
    for r in got:
        if r.doc_id is not None and len(texts[r.doc_id] or "") < 3000:
            text = texts[r.doc_id]
            assert r.score == pytest.approx(best("▁" + text.replace(" ", "▁")) if text else 0.0)
    back = pieces.decode(pieces.encode(docs, path), path)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r[0], r[1] or "") for r in ROWS)


def test_pieces_by_score_are_the_best_path():
    table = [("<unk>", 0.0), ("▁", -3.0), ("a", -2.0), ("b", -2.5), ("ab", -3.1), ("ba", -3.4), ("aba", -5.0), ("▁a", -3.5)]
    model = pieces.Pieces(table, 0, None, list(range(1, 8)), merges=False)

    def best(text):
        if not text:
            return 0.0
        steps = [v + best(text[len(p) :]) for p, v in table[1:] if text.startswith(p)]
        return max([*steps, model.missing + best(text[1:])])

    for text in ("▁abab", "▁aba▁ba", "▁xabbx", "▁"):
        assert model.best(text)[0] == pytest.approx(best(text))


def test_toxicity(spark, docs, none):
    rng = random.Random(2)
    plain = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        ws = rng.choices(plain, k=60)
        if toxic:
            ws[rng.randrange(60)] = "vilewretch" + rng.choice(["ed", "ing", "s"])
        rows.append((i, " ".join(ws))), labels.append((i, int(toxic)))
    labels += [(5, None), (10_000, 1)]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, lab)
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    held = [(r.predicted, k % 4 == 0) for k, r in got.items() if r.held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in odd)
    assert toxicity.score(none, model).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.fit(none, lab)).collect()} == {0.0}


def test_neighbours_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[700:900] = x[5]  # a third of a cell or more: one vector many times
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [rows[3], (9000, None, 0), (9001, [0.0] * 16, 0), (9020, [float("nan")] * 16, 0), (9040, [1.0] * 3, 0), (None, rows[1][1], 0), (9060, [None] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()
    lists = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        lists.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(lists) == set(range(0, 1500, 20))
    hit = 0
    for q, found in lists.items():
        s = x @ x[q]
        assert len(found) == 20 and q not in [v for v, _ in found]
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
        assert all(v == pytest.approx(s[k], rel=1e-12) for k, v in found)
        s[q] = -np.inf
        hit += len({k for k, _ in found} & set(np.lexsort((np.arange(1500), -s))[:20].tolist()))
    assert hit / (20 * len(lists)) >= 0.9
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = neighbours.nearest(df.filter("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0)
    assert [(r.query_id, r["rank"]) for r in few.orderBy("rank").collect()] == [(0, 1), (0, 2)]


def test_neighbour_graph_of_a_dense_cluster(spark):
    rng = np.random.default_rng(3)
    n = 4000
    x = rng.normal(size=(n, 16))
    x[: n // 3] = rng.normal(size=16) * 2 + x[: n // 3] * 0.5
    x /= np.linalg.norm(x, axis=1).max()
    x = np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))]).astype(np.float16)
    nodes = spark.createDataFrame([(i, i % 16, v.tobytes()) for i, v in enumerate(x)], neighbours.struct(id=neighbours.LONG, block=neighbours.LONG, vec=neighbours.BIN))
    g = neighbours.Graph(pivots=2)  # as many rows to a pivot as in a table of a million or more
    got = {}
    for r in neighbours.build(nodes, 16, g).collect():
        for a, b in zip(np.frombuffer(r.a, np.int64).tolist(), np.frombuffer(r.b, np.int64).tolist(), strict=True):
            got.setdefault(a, set()).add(b)
    full = x.astype(np.float32)
    s = full @ full.T
    np.fill_diagonal(s, -np.inf)
    top = np.argpartition(-s, 9, axis=1)[:, :10]
    recall = np.mean([len(got.get(i, set()) & set(top[i].tolist())) / 10 for i in range(n // 3)])
    assert recall > 0.9


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_ngram_join(docs, none, n, percent):
    sets = [(r[0], shingles(r[1], n)) for r in ROWS]
    parent = {i: i for i, _ in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classes(docs, ngram_join.Likeness(n, percent)).collect())
    got = {k: v for k, v in got.items() if k[0] is not None}
    assert got == {k: v for k, v in Counter((i, len(s), root(i)) for i, s in sets if i is not None).items()}
    assert ngram_join.classes(none, ngram_join.Likeness(n, percent)).count() == 0


@pytest.mark.parametrize("edits", [(2, 4), (4, 7)])
def test_ngram_join_of_near_copies_that_are_not_alike(spark, edits):
    """Copies of two texts, edited at few places in few ways: pairs are alike only if they share edits; many are just at the bound."""
    rng, rows = random.Random(5), []
    for k in range(2):
        base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        places = rng.sample(range(150), 24)
        for i in range(170):
            words = list(base)
            for at in rng.sample(places, rng.randint(*edits)):
                words[at] = f"x{rng.randrange(3)}"
            if i % 3 == 0:
                words[rng.randrange(150)] = f"y{i}"
            rows.append((k * 1000 + i, " ".join(words)))
    sets = {i: shingles(t, 3) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and 100 * len(a & b) >= 90 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    got = {r.doc_id: r.component_id for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), ngram_join.Likeness(3, 90)).collect()}
    assert 2 < len(set(got.values())) and got == {i: root(i) for i in sets}


def test_pii(spark, none):
    texts = [
        (1, "mail a.b@c.d.e, x@y a@b.c@d.e"), (2, "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255"), (3, "card 4111 1111 1111 1111, 4111-1111-1111-1112"), (4, "call +1 (415) 555-2671. or +12"),
        (5, "iban DE89370400440532013000 and DE89370400440532013001"), (6, "phone 415-555-2671, part 415-555-2671x"), (7, None), (8, ""), (9, "9" * 50_000 + " " + "a" * 50_000), (10, "𝔘🙂 é a@b.cc"), (10, "𝔘🙂 é a@b.cc"), (None, "a@b.cc"),
    ]
    df = spark.createDataFrame([(i, t, "q") for i, t in texts], "doc_id long, text string, spans string")
    got = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert got[1] == "email:5:14,email:20:25" and got[2] == "ip:0:7,ip:8:15,ip:26:38" and got[3] == "card:5:24"
    assert got[4] == "phone:5:22" and got[5] == "iban:5:27" and got[6].startswith("local_phone:6:18")
    assert got[7] == got[8] == got[9] == "" and got[10] == "email:5:11"
    assert pii.report(df).filter("doc_id = 9").head().best_score is None
    assert {r.doc_id: r.text for r in pii.redact(df).collect()}[3] == "card [CARD], 4111-1111-1111-1112"
    assert pii.redact(df).columns == df.columns and pii.redact(df).filter("doc_id = 7").head().text is None
    assert pii.report(none).count() == 0


def luhn(digits):
    total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def base_spans(text):
    """The stated patterns, run plainly."""
    tests = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(re.sub("[^0-9]", "", v)) <= 19 and luhn(re.sub("[^0-9]", "", v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
    ]
    found = [(m.start(), k, name, m.end()) for k, (name, pattern, ok) in enumerate(tests) for m in re.finditer(pattern, text) if ok(m.group())]
    return sorted(found)


def test_pii_base_kinds_against_the_plain_patterns(spark):
    rng, texts = random.Random(6), [r[1] for r in ROWS]
    bits = ["a.b@c.d", "@", ".", "-", " ", "+1 (415) 555-2671", "10.0.0.1", "256.1.2.3", "4111 1111 1111 1111", "4111111111111112", "5500-0000-0000-0004", "7", "🙂", "é", "x", "(", ")", "+", "\n", "DE89370400440532013000", "1.2.3.4.5"]
    texts += ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.report(df).collect():
        want = base_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, n, b in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(n == k for _, _, n, _ in want) for k in ("email", "ip", "card", "phone"))


def test_pii_context_turns_a_score_both_ways(spark):
    key, social, phone, iban = "0123456789abcdef" * 2, "123-45-6789", "415-555-2671", "DE89370400440532013000"
    texts = [f"token = {key}", f"commit {key}", f"ssn {social}", f"order {social}", f"phone {phone}", f"part {phone}", f"pay to {iban}", f"sample {iban}", "ssn 666-12-3456", "token " + "a" * 40]
    got = [r.n_other for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [1, 0, 1, 0, 1, 0, 1, 0, 0, 0]


def test_pii_of_very_many_spans(spark):
    n = 16_000
    text = " ".join(f"é{i}@mail.example" for i in range(n)) + " 🙂"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    started = time.time()
    row = pii.report(df).head()
    assert row.n_email == n and row.spans.split(",")[0] == "email:1:15" and time.time() - started < 20
    assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in base_spans(text)).encode()).hexdigest()
    started = time.time()
    assert pii.redact(df).head().text == re.sub(r"[0-9]+@mail.example", "[EMAIL]", text) and time.time() - started < 20


@pytest.mark.parametrize("length", [400, 40])
def test_suffix_dedup(docs, none, length):
    data = [(r[0], (r[1] or "").encode()) for r in ROWS]
    seen = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    want = Counter()
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want[i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()] += 1
    assert Counter(tuple(r) for r in suffix_dedup.digest(docs, length).collect()) == want
    assert suffix_dedup.digest(none, length).count() == 0


def test_multikey_sort():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 3, (500, 6)).astype(np.uint64)
    order = suffix_dedup.multikey_sort(keys)
    assert [tuple(r) for r in keys[order]] == sorted(tuple(r) for r in keys)


@pytest.mark.parametrize("length", [50, 8])
def test_substring_dedup(docs, none, length):
    data = [(r[0], (r[1] or "").encode().split()) for r in ROWS]
    first = {}
    for i, w in data:
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, 1 << 62), 1 << 62 if i is None else i)
    want = Counter()
    for i, w in data:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < (1 << 62 if i is None else i):
                gone[k : k + length] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[i, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(tuple(r) for r in substring_dedup.digest(docs, length).collect()) == want
    assert substring_dedup.digest(none, length).count() == 0
    cleaned = substring_dedup.clean(docs, length)
    assert cleaned.columns == docs.columns and cleaned.count() <= len(ROWS)


@pytest.mark.parametrize("partitions", [3, 60])
def test_substring_dedup_at_every_place(spark, partitions):
    rng = random.Random(8)
    say = lambda n: rng.choices(range(10**6), k=n)
    rows, passages = [], [say(n) for n in (120, 60, 90)]
    for i, passage in enumerate(passages):
        changed = [*passage]
        changed[len(changed) // 2] = -1
        block = [*say(30), *passage, *say(40)]
        rows += [(10 * i, say(30) + passage + say(30)), (10 * i + 1, block + say(10) + block), (10 * i + 2, block * 3), (10 * i + 3, changed + say(5) + changed)]
    rows += [(7, say(20) + passages[0][:80] + say(20)), (7, say(9) + passages[0][:80] * 2), (None, say(4) + passages[1] * 2), (None, say(4) + passages[1] + say(2))]
    data, first = [(i, [str(x).encode() for x in w]) for i, w in rows], {}
    for i, w in data:
        for k in range(len(w) - 49):
            first[tuple(w[k : k + 50])] = min(first.get(tuple(w[k : k + 50]), 1 << 62), 1 << 62 if i is None else i)
    want = Counter()
    for i, w in data:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < (1 << 62 if i is None else i):
                gone[k : k + 50] = True
        want[i, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()] += 1
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame([(i, b" ".join(w).decode()) for i, w in data], "doc_id long, text string")
        assert Counter(tuple(r) for r in substring_dedup.digest(df).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_automaton_statistics():
    rng = random.Random(4)
    for _ in range(30):
        refs = [[rng.randrange(3) for _ in range(rng.randint(1, 12))] for _ in range(3)]
        a = substring_dedup.SuffixAutomaton()
        for r in refs:
            a.add(r)
        text = [rng.randrange(3) for _ in range(15)]
        inside = lambda s: any(r[i : i + len(s)] == s for r in refs for i in range(len(r)))
        want = [max([n for n in range(1, k + 2) if inside(text[k + 1 - n : k + 1])], default=0) for k in range(15)]
        assert a.statistics(text) == want


def test_fingerprints(docs, none):
    rows = sorted((r for r in ROWS if r[0] is not None), key=lambda r: -r[0])
    got = {r.doc_id: r for r in fingerprints.edited_pairs(docs).collect()}
    by_text = {}
    texts = [r[1] or "" for r in rows] + [r[1] or "" for r in ROWS if r[0] is None]
    for k, r in enumerate(rows):
        text, g = r[1] or "", got[r[0]]
        assert g.n_chars == len(text)
        assert by_text.setdefault(text, g.fingerprint) == g.fingerprint
        if Counter(x[0] for x in rows)[r[0]] == 1 and rows[k + 1 : k + 2]:
            half = len(text) // 2
            edited = text[: len(text) - half] + texts[k + 1][:half]
            assert g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            a, b = shingles(text, 5), shingles(edited, 5)
            assert abs(g.near_edited - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.25
            if len(a) <= 60 and len(b) <= 60 and a | b and len(a | b) <= 60:
                assert g.near_edited == pytest.approx(len(a & b) / len(a | b))
    assert fingerprints.edited_pairs(none).count() == 0
    assert fingerprints.edited_pairs(docs).count() == len(ROWS)


def test_sketches_merge(spark):
    df = spark.createDataFrame([("a b c d e f g h", "q r s t u v w x y")], "x string, y string")
    sk = fingerprints.sketch
    row = df.select(fingerprints.merge(sk(F.col("x")), sk(F.col("y"))).alias("m"), F.array_sort(F.array_union(sk(F.col("x")), sk(F.col("y")))).alias("u"), fingerprints.containment(sk(F.col("x")), sk(F.col("x"))).alias("c"), fingerprints.distinct_shingles(sk(F.col("x"))).alias("n")).head()
    assert row.m == row.u and row.c == 1.0 and row.n == 4.0


def test_language_gradients():
    rng = np.random.default_rng(0)
    net = language.Network(["a", "b"], language.new_direction(rng, 3), language.new_direction(rng, 3), rng.normal(size=(6, 2)), np.zeros(2))
    for d in (net.ahead, net.back):
        d.inputs, d.state, d.bias = (p.astype(np.float64) for p in d.parts())
    x, y = rng.integers(97, 101, (5, 4)).astype(np.uint8), np.array([0, 1, 1, 0])
    _, grads = net.gradients(x, y)
    for part, grad in zip(net.parts(), grads, strict=True):
        at = tuple(rng.integers(0, n) for n in part.shape) if part.shape[0] != 256 else (int(x[0, 0]), 1)
        part[at] += 1e-3
        up = net.gradients(x, y)[0]
        part[at] -= 2e-3
        down = net.gradients(x, y)[0]
        part[at] += 1e-3
        assert grad[at] == pytest.approx((up - down) / 2e-3, abs=2e-3)


def test_language(spark, docs, none):
    rng = random.Random(3)
    say = lambda letters, n: " ".join("".join(rng.choices(letters, k=5)) for _ in range(n))
    rows = [(i, say("abcdef" if i % 2 else "uvwxyz", rng.randint(3, 60)), "one" if i % 2 else "two") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.fit(d, steps=120)
    got = {r.doc_id: r for r in language.predict(d, net).collect()}
    held = [r.lang_pred == ("one" if k % 2 else "two") for k, r in got.items() if r.held_out]
    assert sum(held) / len(held) > 0.97
    odd = Counter((r[0], r[1]) for r in ROWS)
    mine = language.predict(docs, net).collect()
    assert len(mine) == len(ROWS) and all(0 <= r.score <= 1 for r in mine)
    for r in mine:
        text = [t for (i, t) in odd if i == r.doc_id]
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not text[0] or not any(c.isalpha() for c in text[0]))
    assert language.predict(none, net).count() == 0
    assert {r.lang_pred for r in language.predict(docs, language.fit(none)).collect()} == {"und"}
    assert language.keep_known(docs, net, 0.0).columns == docs.columns
    kept = {r.doc_id for r in language.keep_known(d, net).collect()}
    assert len(kept) >= 297 and 0.5 < net.least_score < 0.9
    assert kept == {k for k, r in got.items() if r.score >= net.least_score}
    mixed = spark.createDataFrame([(1, say("abcdef", 20) + " " + say("uvwxyz", 4)), (2, "ab uv " * 40), (3, "12 34"), (4, None)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in language.predict(mixed, net).collect()}
    assert {r.doc_id for r in language.keep_known(mixed, net).collect()} == {k for k in (1, 2) if scores[k] >= net.least_score} >= {1}
    assert language.keep_known(mixed, net, scores[2] + 1e-9 if scores[2] < scores[1] else 1.0).count() <= 1
    assert {r.doc_id for r in language.keep_known(mixed, None).collect()} == {1, 2}


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    got = packing.pack_documents(docs, BPE).toPandas()
    want = Counter()
    for r in ROWS:
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (s, n) in enumerate(packing.cut_points(len(ids), 2048)):
            want[r[0], k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter((None if r[0] != r[0] else int(r[0]), *map(int, r[1:])) for r in got[cols].itertuples(index=False)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist() and g["length"].sum() <= 2048
    sequences = got.groupby("sequence_id")["length"].sum()
    assert len(sequences) <= -(-got["length"].sum() // 2048) + 1
    assert packing.pack_documents(none, BPE).count() == 0


def test_tokens_are_those_of_the_library():
    from tokenizers import Tokenizer

    rng, tok, fast = random.Random(9), Tokenizer.from_file(BPE), packing.FastTokenizer(BPE)
    bits = ["a", "the", " ", "  ", "\n", "\t", "'s", "12", "é", "🙂", "\u0301", "<|endoftext|>", "<|", "...", "\u3000", "\x00"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(500)] + [r[1] or "" for r in ROWS] + ["a<|endoftext|>b", "a" * 5000]
    assert fast.ranks is not None
    assert fast.encode(texts) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert np.frombuffer(fast.encode(["a<|endoftext|>b"])[0], "<u4").tolist() == [64, 50256, 65]


def test_every_capacity_changes_the_packing():
    lengths = np.random.default_rng(5).integers(1, 900, 600)
    plain = packing.best_fit(lengths, packing.Capacity(2048, 2048, None, (1.0, 0.0, 0.0)))[0]
    for other in (packing.Capacity(), packing.Capacity(2048, 4), packing.Capacity(2048, 512, 900_000.0), packing.Capacity(rule="dot")):
        assert (packing.best_fit(lengths, other)[0] != plain).any()


def test_equal_rows_are_packed_in_several_groups(spark):
    df = spark.createDataFrame([(7, "one two three " * 40)] * 9000, "doc_id long, text string")
    sizes = packing.pack_documents(df, BPE).selectExpr("sequence_id >> 32 as g").groupBy("g").count().collect()
    assert sum(r["count"] for r in sizes) == 9000 and len(sizes) == 3 and max(r["count"] for r in sizes) < 5000


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_respects_every_capacity(rule):
    lengths = np.random.default_rng(0).integers(1, 100, 400)
    cap = packing.Capacity(100, 3, 5000.0, (1.0, 0.5, 0.5), rule)
    bins, offsets = packing.best_fit(lengths[lengths**2 <= 5000], cap)
    kept = lengths[lengths**2 <= 5000]
    for b in set(bins.tolist()):
        own = kept[bins == b]
        assert own.sum() <= 100 and len(own) <= 3 and (own**2).sum() <= 5000
        assert sorted(offsets[bins == b]) == sorted((np.cumsum(own[np.argsort(offsets[bins == b])]) - own[np.argsort(offsets[bins == b])]).tolist())
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), cap)


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert [n for n, _ in P.STAGES] == ["language", "near_copies", "repeats", "personal_data", "packing"]
    before = docs
    for _, stage in P.STAGES[:-1]:
        after = stage(spark, before, "")
        after = spark.createDataFrame(after.collect(), after.schema)
        assert after.columns == docs.columns and after.count() <= before.count()
        before = after
    assert P.STAGES[-1][1](spark, before, "").count() >= before.count()


def test_short_documents_fill_sequences(spark):
    empty = spark.range(10_000).selectExpr("id as doc_id", "cast(null as string) as text")
    assert packing.pack_documents(empty, BPE).select("sequence_id").distinct().count() <= 5 + 3  # one more a group at most
    lengths = np.random.default_rng(8).integers(1, 40, 4096)
    for sizes, fewest in ((lengths, -(-lengths.sum() // 2048)), (np.full(4096, 5), -(-4096 // (2048 // 5))), (np.full(4096, 1), 2)):
        assert packing.best_fit(sizes, packing.Capacity())[0].max() + 1 == fewest
